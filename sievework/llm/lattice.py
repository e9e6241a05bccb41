"""Word lattices for scripts without spaces: Japanese, Chinese and Thai.

A stretch of text is segmented by the cheapest path through the lattice of its possible words. Words come from
the multi-character entries of a public tokenizer's vocabulary (its path is a parameter, an entry's rank its
cost), from the closed classes below, and from runs of one script for what no dictionary holds. The classes say
what a gap's neighbours do: end a sentence, open one, or tie the gap to what stands before it.
"""

from __future__ import annotations

import base64
import math
import re
from functools import lru_cache

from sievework.llm.tokens import VOCABULARY

#: Endings and particles after which a Japanese sentence can be over.
JA_FINAL = frozenset("です ます でした ました ません ませんでした ない なかった である であった だった だろう でしょう ましょう ください なさい た だ よ ね か な わ さ ぞ ぜ かな よね".split())
#: Particles and forms after which it goes on, and with which no sentence starts.
JA_TIED = frozenset("は が を に で と も の から まで より へ や し ので のに けど けれど けれども ながら たり て って という として など だけ ほど ば とは では には".split())
#: Words that open a Japanese sentence: demonstratives, question words, conjunctions, persons, times, interjections.
JA_OPEN = frozenset(
    """この その あの どの これ それ あれ どれ ここ そこ あそこ どこ こう そう なぜ どうして どう いつ 誰 何 また しかし そして さらに ただし なお だから つまり 例えば 次に まず もし もちろん
    ところで それで でも では すると ですから したがって 一方 詳しく 私 僕 俺 彼 彼女 私たち 今 今日 昨日 明日 今回 え ええ はい いいえ あ いや""".split()
)
ZH_FINAL = frozenset("了 吗 嗎 吧 呢 啊 呀 嘛 啦 的 罢了 而已".split())
ZH_TIED = frozenset("的 地 得 但 而 并 並 却 卻 和 与 與 或 及 以及 之".split())
ZH_OPEN = frozenset(
    """这 這 这个 這個 这里 這裡 这些 這些 那 那个 那個 那里 那裡 那些 我 我们 我們 你 您 你们 你們 他 她 它 他们 他們 为什么 為什麼 怎么 怎麼 什么 什麼 谁 誰 哪 请 請 如果 因为 因為 所以 但是 不过
    不過 然而 而且 因此 于是 於是 首先 其次 然后 然後 最后 最後 另外 当 當 虽然 雖然 真的 其实 其實 现在 現在 今天 昨天 明天 等等""".split()
)
TH_FINAL = frozenset("ครับ ค่ะ คะ นะ จ้ะ จ๊ะ สิ ล่ะ เลย แล้ว ไหม มั้ย หรือไม่ หรือยัง".split())
TH_OPEN = frozenset("แต่ และ เพราะ ถ้า เมื่อ ดังนั้น จากนั้น อย่างไรก็ตาม นอกจากนี้ ทำไม อย่างไร ใคร อะไร ฉัน ผม เรา เขา มัน นี่ นั่น".split())

HAN, KANA, THAI = r"㐀-鿿豈-﫿々〆", r"぀-ヿｦ-ﾟー", r"฀-๿"
SPACELESS = re.compile(rf"[{HAN}{KANA}{THAI}]")
_KANA = re.compile(r"[぀-ヿｦ-ﾟ]")
_HIRAGANA = re.compile(r"[ぁ-ゟ]+\Z")
#: Stretches that are segmented as one; words of other scripts inside belong to them.
_STRETCH = re.compile(rf"[{HAN}{KANA}{THAI}A-Za-z0-9_]+")
_RUNS = re.compile(rf"[A-Za-z0-9_]+|[゠-ヿｦ-ﾟー]+|[ぁ-ゟ]|[{HAN}]|[{THAI}]|.", re.DOTALL)
#: Kana on which plain predicates end: the u-row, the past, and adjectives.
_PREDICATE = frozenset("うくぐすつぬぶむるただい")
_CLOSED = JA_FINAL | JA_TIED | JA_OPEN | ZH_FINAL | ZH_TIED | ZH_OPEN | TH_FINAL | TH_OPEN
#: Costs: a closed-class word, a character no dictionary holds, an unknown run of one script, and each further word.
CLOSED_COST, UNKNOWN_COST, RUN_COST, WORD_COST = 4.0, 10.0, 9.0, 2.0


@lru_cache(2)
def dictionary(path: str = VOCABULARY) -> tuple[dict[str, float], int]:
    """Words with their costs, and the length of the longest."""
    words: dict[str, float] = {}
    whole = re.compile(rf"[{HAN}{KANA}{THAI}]{{2,}}\Z")
    with open(path, "rb") as f:
        for token, rank in map(bytes.split, f):
            try:
                word = base64.b64decode(token).decode().strip()
            except UnicodeDecodeError:
                continue  # a part of a character
            if whole.match(word) and word[-1] not in ZH_FINAL and word[0] not in ZH_FINAL:  # particles are words of their own
                words[word] = min(words.get(word, math.inf), math.log(int(rank) + 2))
    for word in _CLOSED:
        words[word] = min(words.get(word, math.inf), CLOSED_COST)
    return words, max(map(len, words))


def segment(stretch: str, path: str = VOCABULARY) -> list[str]:
    """Words of a stretch on the cheapest path through its lattice; ties go to the longer first word."""
    words, longest = dictionary(path)
    n = len(stretch)
    run_end = [0] * n
    for m in _RUNS.finditer(stretch):
        for i in range(m.start(), m.end()):
            run_end[i] = m.end()
    best = [math.inf] * n + [0.0]
    step = [0] * n
    for i in range(n - 1, -1, -1):
        for j in range(min(n, i + longest), i, -1):
            cost = words.get(stretch[i:j])
            if cost is not None and cost + WORD_COST + best[j] < best[i]:
                best[i], step[i] = cost + WORD_COST + best[j], j
        j = run_end[i]
        cost = (UNKNOWN_COST if j == i + 1 else RUN_COST) + WORD_COST + best[j]
        if cost < best[i]:
            best[i], step[i] = cost, j
    out, i = [], 0
    while i < n:
        out.append(stretch[i : step[i]])
        i = step[i]
    return out


def words_before(text: str, at: int, lo: int, path: str = VOCABULARY) -> list[str]:
    """The words of the stretch that ends at ``at``."""
    a = at
    while a > lo and _STRETCH.match(text[a - 1]):
        a -= 1
    return segment(text[a:at], path)


def words_after(text: str, at: int, end: int, path: str = VOCABULARY) -> list[str]:
    """The words of the stretch that starts at ``at``."""
    m = _STRETCH.match(text, at, end)
    return segment(m[0], path) if m else []


def is_japanese(*sides: list[str]) -> bool:
    return any(_KANA.search(w) for words in sides for w in words)


def closes(before: list[str], japanese: bool) -> bool | None:
    """Whether the words before a gap end a sentence (True), run on (False), or neither is plain (None)."""
    if not before:
        return None
    last = before[-1]
    if not japanese:
        return True if last in ZH_FINAL or last in TH_FINAL else False if last in ZH_TIED or last in ZH_OPEN and last != "等等" else None
    if last in JA_FINAL:
        return True
    # inflection is spelled in hiragana, so the kana at the end are looked at together
    tail, i = last, len(before) - 1
    while i > 0 and _HIRAGANA.match(before[i]) and len(tail) < 2:
        i -= 1
        tail = before[i] + tail
    if last in JA_TIED or tail[-1] in "てでをにはがもと":
        return False
    return True if _HIRAGANA.search(tail[-1]) and tail[-1] in _PREDICATE else None


def opens(after: list[str], japanese: bool) -> bool | None:
    """Whether the words after a gap open a sentence (True), belong to what stands before it (False), or neither is plain."""
    if not after:
        return None
    first = after[0]
    if not japanese:
        return True if first in ZH_OPEN or first in TH_OPEN else False if first in ZH_TIED else None
    if first in JA_OPEN:
        return True
    if first in JA_TIED:
        return False
    # a topic or subject: nouns up to the first particle, which is は or が
    particle = next((w for w in after if w in JA_TIED), None)
    return True if particle in ("は", "が", "とは", "では", "には") and not _HIRAGANA.match(first) else None
