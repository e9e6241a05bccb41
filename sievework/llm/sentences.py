"""Problem 9: sentence units of every document, across languages and scripts.

A text is cut into blocks (headings, list items, fences, paragraphs). Spaced scripts then run
through a terminator lattice: every end mark is a node whose class (decimal, abbreviation, initial,
ordinal, quoted, ellipsis, end) follows from what stands around it. Around the gaps of spaceless
scripts that no end mark decides, the text is segmented by a dictionary word lattice; final
particles and endings before the gap and opening words after it decide. Beside Thai a blank or a
line break is an end mark of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import lattice
from sievework.llm.tokens import VOCABULARY
from sievework.session import read

# --- fixed word lists ------------------------------------------------------------------------
#: Abbreviations that never end a sentence: something they belong to follows.
BEFORE = frozenset(
    """e.g i.e dr mr mrs ms prof rev gen sen rep st mt no nos vs cf sec secs fig figs eq eqs ch chs vol vols pp approx ca
    jan feb mar apr jun jul aug sep sept oct nov dec al ed eds resp incl excl max min dept est
    z.b d.h u.a.m s.o s.u bzw ca abschn abb abs nr art tab kap bd hr fr frau evtl ggf vgl sog inkl zzgl geb st bspw z b
    p.ex c.-à-d env art fig p pp n° mme mlle mm m me chap éd av
    sr sra srta dra d dña pág págs pag art núm num aprox ej p.ej vol cap fig ud uds ee.uu
    т.е напр см рис п пп ст стр гл табл им проф акад ред св тыс обл ул г-н г-жа ок
    д أ.د ص ج د أ م
    सं डॉ श्री प्रो पृ क्र""".split()
)
#: Abbreviations that end a sentence when a new one plainly opens after them.
MAYBE = frozenset(
    """etc a.m p.m u.s u.k u.n inc ltd co corp jr bros ph.d b.c a.d
    usw u.a u.s.w etc
    etc
    т.д т.п др гг г в вв н.э мин сек ч руб коп млн млрд тыс кг км""".split()
)
OPEN = {"“": "”", "«": "»", "„": "“", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", "‹": "›", "‚": "‘"}
CLOSERS = frozenset("”»“」』）)]】》〉›’\"'‘")
MARKS = frozenset(".!?…。！？।॥؟۔｡．")
CJK_MARKS = frozenset("。！？｡．")
#: Words that carry a sentence on after a closing quotation, in scripts without capitals.
CARRY = frozenset("ثم و فقط لكن أو وقال في على إلى عن और तथा या फिर लेकिन पर तो कहकर कि ने को से में".split())
_FENCE = re.compile(r"[ \t]*(```+|~~~+)")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?=[ \t\r\n]|$)")
_ITEM = re.compile(r"[ \t]*(?:[-*+•‣◦–]|\d{1,3}[.)])[ \t]+(?=\S)")
_LINE = re.compile(r"[^\r\n  \x0b\x0c\x85]*(?:\r\n|[\r\n  \x0b\x0c\x85]|\Z)")
_THAI = re.compile(r"[฀-๿]")
_SPACELESS = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ]")
_LETTER = r"(?:[^\W\d_]|[\u0300-\u036f\u064b-\u065f\u0900-\u0903\u093a-\u0963])"
_LETTERS = re.compile(_LETTER)
_SECOND_HALF = re.compile(r"\.\s*[^\W\d_]\.")
_ELISION = re.compile(r"^(?:[ldnsjqmtc]|qu)[’']", re.IGNORECASE)
#: What the scan of a paragraph can't pass by; white space counts only beside spaceless scripts.
_NODE = re.compile(r"[`\"“”«»„「」『』（）()\[\]【】《》〈〉‹›‚‘.!?…。！？।॥؟۔｡．]")
_NODE_WS = re.compile(_NODE.pattern[:-1] + r"\s\u200b]")
_SUBJECT = re.compile(r"\w+(?:\([^)\n]*\))?!?: ")


def _blocks(text: str, source: str | None) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the blocks: unit, item or para."""
    pos, n = 0, len(text)
    first = True
    para: int | None = None
    last = 0
    while pos < n:
        m = _LINE.match(text, pos)
        stop = m.end()
        line = m[0].rstrip("\r\n  \x0b\x0c\x85")
        blank = not line.strip().strip("﻿")
        start = pos
        fence = _FENCE.match(line)
        kind = None
        if blank:
            kind = "blank"
        elif fence:
            kind = "unit"
            mark = fence[1]
            p = stop
            end = start + len(line)
            while p < n:
                m2 = _LINE.match(text, p)
                body = m2[0].strip()
                end = p + len(m2[0].rstrip("\r\n"))
                p = m2.end()
                if body.startswith(mark) and not body.strip(mark[0]):
                    break
            stop = p
        elif first and (source == "commit-messages"):
            kind, end = "unit", start + len(line)
        elif _HEADING.match(line):
            kind, end = "unit", start + len(line)
            start += len(line) - len(line.lstrip())
        elif _ITEM.match(line):
            kind, end = "item", start + len(line)
        if not blank:
            first = False
        if kind is None:
            if para is None:
                para = start
            last = start + len(line)
        else:
            if para is not None:
                yield para, last, "para"
                para = None
            if kind != "blank":
                yield start, end, kind
        pos = stop
    if para is not None:
        yield para, last, "para"


def _spaces_back(text: str, i: int, lo: int) -> int:
    while i > lo and text[i - 1].isspace():
        i -= 1
    return i


def _letter(c: str) -> bool:
    return bool(_LETTERS.match(c))


def _word_back(text: str, i: int, lo: int) -> int:
    """Start of the word that ends at ``i``: letters, joined by periods, hyphens or apostrophes between them."""
    start = i
    while i > lo:
        c = text[i - 1]
        if _letter(c):
            start = i - 1
        elif not (c in ".’'-" and start - i < 2):
            break
        i -= 1
    return start


def _is_abbreviation(text: str, dot: int, lo: int) -> str | None:
    """Class of the abbreviation that ends with the period at ``dot``: before, maybe, initial or None."""
    s = _word_back(text, dot, lo)
    if s == dot:
        return None
    word = text[s:dot]
    if s > lo and text[s - 1] in "_/\\`-@" and not word[0].isupper():
        return None  # the tail of a path or name
    word = _ELISION.sub("", word)
    low = word.lower()
    # joined forms with spaces between: "z. B.", "т. д.", "u. a.", "d. h."
    e = _spaces_back(text, s, lo)
    if len(low) <= 2 and e - 1 > lo and text[e - 1] == "." and text[e - 2].isalpha():
        first = e - 3 if e - 3 >= lo and text[e - 3].isalpha() else e - 2
        pair = f"{text[first : e - 1].lower()}.{low}"
        if pair in MAYBE or pair in ("т.д", "т.п", "u.a"):
            return "maybe"
        if pair in BEFORE or pair in ("т.е", "z.b", "d.h", "s.o", "s.u", "p.ex"):
            return "before"
    if low in MAYBE:
        return "maybe"
    if low in BEFORE:
        return "before"
    if len(word) == 1 and word.isupper():
        return "initial"
    if len(word) == 1 and word.isalpha() and _SECOND_HALF.match(text, dot):
        return "before"  # the first half of "z. B." or "т. д."
    return None


def _opens(text: str, p: int, end: int) -> bool:
    """Whether what starts at ``p`` looks like the start of a sentence rather than its middle."""
    c = text[p]
    if c.isupper() or c.istitle() or c in "“«„「『（([\"'¿¡`*_<‘‚" or c.isdigit():
        return True
    if not c.isalpha():
        return not (c in ",;:%)]}-–—/=+" or c in CLOSERS)
    if not (c.islower()):
        return True  # scripts without capitals
    w = re.compile(r"[^\s,;:!?]+").match(text, p)[0]
    return bool(re.search(r"[A-Z_()/\d]|\.\w", w[1:]))


def _paragraph(text: str, lo: int, end: int, vocabulary: str) -> Iterator[tuple[int, int]]:
    """Sentences of a paragraph or item in [lo, end)."""
    start = lo
    stack: list[str] = []
    p = lo
    code = False
    body = text[lo:end]
    node = (_NODE_WS if _THAI.search(body) or _SPACELESS.search(body) else _NODE).search
    while p < end:
        m = node(text, p, end)
        if not m:
            break
        p = m.start()
        c = text[p]
        if c == "`":
            code = not code and text.find("`", p + 1, end) >= 0
            p += 1
            continue
        if code:
            p += 1
            continue
        if c in OPEN and not (c == "“" and stack and stack[-1] == "“"):
            # an opening without its closing in the paragraph is no quotation
            if text.find(OPEN[c], p + 1, end) >= 0:
                stack.append(OPEN[c])
            p += 1
            continue
        if stack and c == stack[-1]:
            stack.pop()
            p += 1  # never an end by itself: an end mark before it was judged with it
            continue
        if c == '"':
            if text.find('"', p + 1, end) >= 0:
                stack.append('"')
            p += 1
            continue
        if c in " \t\r\n 　​" and not stack:
            q = p
            while q < end and text[q].isspace():
                q += 1
            gap = text[p:q]
            if start < p and q < end and _thai_gap(text, start, p, q, end):
                yield start, p
                start = q
            elif start < p and q < end and ("\n" in gap or "\r" in gap) and _cjk_line(text, start, p, q, end, vocabulary):
                yield start, p
                start = q
            p = q
            continue
        if c not in MARKS:
            p += 1
            continue
        # a node of the lattice: the run of marks, then the closings that belong to it
        q = p + 1
        while q < end and text[q] in MARKS:
            q += 1
        run = text[p:q]
        closed = q
        depth = list(stack)
        while closed < end and text[closed] in CLOSERS:
            if depth and text[closed] == depth[-1]:
                depth.pop()
            elif depth or text[closed] in "\"'‘“":
                break
            closed += 1
        # French spaces stand before marks, and before closing guillemets
        if depth and closed < end and text[closed] in "   " and text[closed + 1 : closed + 2] == depth[-1] == "»":
            closed += 2
            depth.pop()
        if depth:
            p = q  # still inside a quotation or brackets
            continue
        quoted = bool(stack)
        if _ends(text, lo, start, p, q, closed, end, run, quoted, vocabulary):
            stack = []
            yield start, closed
            start = p = closed
        else:
            stack = []
            p = max(q, closed)
    if start < end:
        yield start, end


def _thai_gap(text: str, start: int, p: int, q: int, end: int) -> bool:
    """White space in Thai running text: Thai stands right beside it, or in both words around it."""
    if _THAI.match(text[p - 1]) or _THAI.match(text[q]):
        return True
    a, b = p, q
    while a > start and not text[a - 1].isspace():
        a -= 1
    while b < end and not text[b].isspace():
        b += 1
    return bool(_THAI.search(text, a, p) and _THAI.search(text, q, b))


def _cjk_line(text: str, start: int, p: int, q: int, end: int, vocabulary: str) -> bool:
    """A line break between spaceless text: over only if an ending meets an opening."""
    if not (_SPACELESS.match(text[p - 1]) and _SPACELESS.match(text[q])):
        return False
    before, after = lattice.words_before(text, p, start, vocabulary), lattice.words_after(text, q, end, vocabulary)
    ja = lattice.is_japanese(before, after)
    return lattice.closes(before, ja) is True and lattice.opens(after, ja) is True


def _ends(text: str, lo: int, start: int, p: int, q: int, closed: int, end: int, run: str, quoted: bool, vocabulary: str) -> bool:
    """Whether the marks at [p, q), with closings up to ``closed``, end the sentence."""
    if closed >= end:
        return True
    c = text[closed]
    before = text[p - 1] if p > lo else ""
    spaceless = bool(_SPACELESS.match(before)) or run[0] in CJK_MARKS or (bool(_SPACELESS.match(c)) and not c.isspace())
    gap = c.isspace()
    r = closed
    while r < end and text[r].isspace():
        r += 1
    if r >= end:
        return True
    nxt = text[r]
    if quoted:
        if not gap and not spaceless:
            return False  # a particle is tied to the quotation
        if nxt in ",;:，、；：)）.":
            return False
        if spaceless:
            after = lattice.words_after(text, r, end, vocabulary)
            return lattice.opens(after, lattice.is_japanese(after)) is not False
        if nxt.islower():
            return False
        if nxt.isalpha() and not nxt.isupper():
            word = re.compile(r"[^\s.,!?।؟]+").match(text, r)[0]
            return word not in CARRY and not ("؀" <= nxt <= "ۿ" and word[0] == "و" and len(word) > 4 and word in CARRY)
        return True
    if run[0] in CJK_MARKS or any(x in "।॥؟۔" for x in run):
        return nxt not in "，、；："
    dots = run.strip(".") == "" or run.strip("…") == ""
    if not gap:
        if dots and len(run) > 1 or run[0] == "…":
            if spaceless:
                return _ellipsis_ends(text, start, p, r, end, vocabulary)
            return False
        if spaceless and run[0] in "!?":
            return True
        if run[0] in "!?" and (nxt.isupper() or _SPACELESS.match(nxt)) and not before.isascii():
            return True
        return bool(_THAI.match(before) and _THAI.match(nxt) and run[0] in "!?")
    if dots and (len(run) > 1 or run[0] == "…"):
        if spaceless:
            return _ellipsis_ends(text, start, p, r, end, vocabulary)
        return _opens(text, r, end)
    if run != ".":
        return _opens(text, r, end)
    # a single period before white space
    if before.isspace() or before == "":
        return False
    abbr = _is_abbreviation(text, p, lo)
    if abbr == "before":
        return False
    if abbr == "initial":
        # an initial before a name; a sentence may still end in a capital ("plan B.") before a function word
        word = re.compile(r"[^\W\d_]+").match(text, r)
        return not (word and nxt.isupper())
    if abbr == "maybe":
        return nxt.isupper() or nxt in "“«„¿¡([`"
    if before.isdigit():
        if _ordinal(text, start, p, lo) and (nxt.isupper() or nxt.islower()):
            return False
    return _opens(text, r, end)


#: Words before a German ordinal.
ORDINAL = frozenset("der die das den dem des am im vom zum zur beim ab bis seit jeder jede jedes ein eine unser dieser diese".split())


def _ordinal(text: str, start: int, p: int, lo: int) -> bool:
    """Whether the number of one or two digits that ends at ``p`` follows an article or preposition, as a German ordinal does."""
    d = p
    while d > lo and text[d - 1].isdigit():
        d -= 1
    e = _spaces_back(text, d, start)
    return 0 < p - d <= 2 and e < d and text[_word_back(text, e, start) : e].lower() in ORDINAL


def _ellipsis_ends(text: str, start: int, p: int, r: int, end: int, vocabulary: str) -> bool:
    """Three dots between spaceless text.

    Japanese: an ending before them ends the sentence, a connective form runs on, after anything else an opening decides.
    Chinese, whose ellipsis closes a clause: over, unless a connective follows, the clause is only begun (it ends in a
    pronoun or conjunction), or its one word is said again.
    """
    before, after = lattice.words_before(text, p, start, vocabulary), lattice.words_after(text, r, end, vocabulary)
    ja = lattice.is_japanese(before, after)
    closed, opened = lattice.closes(before, ja), lattice.opens(after, ja)
    if opened is False or text[r] in "、，；：":
        return False
    if ja:
        return closed is True or (closed is None and opened is True)
    return closed is not False and not (len(before) == 1 and before == after[:1])


def sentences(text: str | None, source: str | None = None, vocabulary: str = VOCABULARY) -> list[tuple[int, int]]:
    """Code-point spans of the sentence units of a text, without surrounding white space."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    for lo, hi, kind in _blocks(text, source):
        if kind == "unit":
            spans: Iterator[tuple[int, int]] = iter([(lo, hi)])
        elif kind == "item":
            m = _ITEM.match(text, lo, hi)
            body = m.end()
            got = list(_paragraph(text, body, hi, vocabulary))
            if got:
                got[0] = (lo, got[0][1])
            spans = iter(got)
        else:
            spans = _paragraph(text, lo, hi, vocabulary)
        for s, e in spans:
            while s < e and (text[s].isspace() or text[s] in "﻿​"):
                s += 1
            while e > s and (text[e - 1].isspace() or text[e - 1] in "﻿​"):
                e -= 1
            if s < e:
                out.append((s, e))
    return out


def _split(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ends = [], [], []
            for key, text, source in zip(*(b.column(i).to_pylist() for i in range(3))):
                for s, e in sentences(text, source, vocabulary):
                    ids.append(key)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "start_char", "end_char"])

    return run


def split_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, start_char, end_char)``, one row per sentence unit; no shuffle.

    Null, empty and blank texts give no row; repeated texts are split once per row; a null source
    only means that no subject line is looked for; whole texts of any length are processed; other
    columns are not read. ``vocabulary`` is the tokenizer file whose words the lattices know.
    """
    return docs.select(F.col(key).cast("long"), F.col(text), F.col(source)).mapInArrow(_split(vocabulary), "doc_id long, start_char int, end_char int")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split_sentences(read(spark, sf_dir, "documents"))
    return s


def p9_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's list of sentences with their positions; documents without any have an empty list."""
    docs = read(spark, sf_dir, "documents")
    s = split_sentences(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char"))).alias("spans"))
    d = docs.select("doc_id", "text").join(s, "doc_id", "left")
    cut = F.transform(F.coalesce("spans", F.array()), lambda x: F.struct(x.start_char.alias("start_char"), x.end_char.alias("end_char"), F.substring("text", x.start_char + 1, x.end_char - x.start_char).alias("sentence")))
    return d.select("doc_id", F.size(cut).alias("n_sentences"), cut.alias("sentences"))


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every document: units in order, apart, trimmed, and together all of its characters but white space."""
    blank = r"(?U)[\s\u200b\ufeff]+"
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text", F.regexp_replace("text", blank, "").alias("all")).filter(F.col("all") != "")
    s = split_sentences(read(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char"))).alias("u"))
    d = docs.join(s, "doc_id", "left")
    cut = F.transform("u", lambda x: F.substring("text", x.start_char + 1, x.end_char - x.start_char))
    before = F.transform(F.sequence(F.lit(2), F.size("u")), lambda i: F.element_at("u", i)["start_char"] >= F.element_at("u", i - 1)["end_char"])
    apart = F.when(F.size("u") > 1, F.forall(before, lambda x: x)).otherwise(True)
    trimmed = F.forall(cut, lambda x: ~x.rlike(r"(?U)\A\s|\s\z"))
    return d.select("doc_id", F.coalesce(apart, F.lit(False)).alias("apart"), F.coalesce(trimmed, F.lit(False)).alias("trimmed"), F.coalesce(F.regexp_replace(F.array_join(cut, ""), blank, "") == F.col("all"), F.lit(False)).alias("whole"))


QUERIES = {"p9_found": p9_found, "p9_per_document": p9_per_document, "p9_checks": p9_checks}
ORACLE = {
    "p9_checks": "SELECT doc_id, true AS apart, true AS trimmed, true AS whole FROM documents WHERE regexp_replace(text, '[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+', '', 'g') <> ''",
}
