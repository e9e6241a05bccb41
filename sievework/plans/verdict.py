"""Verdicts on findings: gate, algebra, chunked prompts and the provider protocol."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_C = F.col
#: Detectors whose findings always get a verdict, and those that get one unless low (fixed).
ALWAYS = "mutation race-condition shared-db-write api-race dead-export dead-module dead-handler dead-api todo-comments hot-hub-file long-file long-function magic-numbers".split()
UNLESS_LOW = "silent-catch public-any mutable-globals bad-config similar-functions".split()
DUPLICATES = ("duplicate-type", "duplicate-function")
#: Sites per call, characters per prompt, and sites per chunk beyond that (fixed).
MAX_SITES, PROMPT_CHARS, CHUNK_SITES = 8, 3500, 2
AUTO_FP = 0.6


def needs_verdict(names: Column | None = None, fields: Column | None = None) -> Column:
    """Gate over findings; ``names`` and ``fields`` are the distinct names of a duplicate and its field count."""
    d = _C("detector_id")
    dup = d.isin(*DUPLICATES)
    vague = (_C("layer") >= 2) | (_C("confidence") < 0.95)
    small = (names >= 2) & fields.between(1, 3) if names is not None and fields is not None else F.lit(False)
    return F.when(d.isin(*ALWAYS), True).when(d.isin(*UNLESS_LOW), _C("severity") != "low").when(dup, vague | small).otherwise(False)


def apply_verdicts(findings: DataFrame, verdicts: DataFrame, threshold: float = 0.7, auto_fp: float = AUTO_FP) -> DataFrame:
    """Findings after their verdicts (fingerprint, positive, confidence, reason); without one they stay as they are.

    Positive: confidence up to the verdict's, at most 0.95 (duplicates 0.97); a medium severity rises from a
    verdict of 0.85 on, except for duplicates. Negative: confidence falls (duplicates: min(c, 1 - v) * 0.7),
    below ``threshold`` the severity is low, from ``auto_fp`` on the finding is an automatic false positive.
    The layer becomes 3, for duplicates only when positive. Of several verdicts the most confident holds.
    """
    v = verdicts.groupBy("fingerprint").agg(F.max(F.struct("confidence", "positive", "reason")).alias("v"))
    j = findings.join(v, "fingerprint", "left")
    has, pos, conf, c = _C("v").isNotNull(), _C("v.positive"), _C("v.confidence"), _C("confidence")
    dup = _C("detector_id").isin(*DUPLICATES)
    up = F.least(F.when(dup, 0.97).otherwise(0.95), F.greatest(c, conf))
    down = F.when(dup, F.least(c, 1 - conf) * 0.7).otherwise(F.greatest(F.lit(0.0), c * (1 - conf)))
    new = F.when(~has, c).when(pos, up).otherwise(down)
    sev = F.when(has & pos & ~dup & (_C("severity") == "medium") & (conf >= 0.85), "high").when(has & ~pos & (down < threshold), "low").otherwise(_C("severity"))
    fp = F.when(has & ~pos & (conf >= auto_fp), F.struct(conf.alias("confidence"), _C("v.reason").alias("reason"))).otherwise(_C("llm_false_positive"))
    layer = F.when(has & (pos | ~dup), 3).otherwise(_C("layer"))
    note = F.when(has, F.concat("description", F.lit("\n\nVerdict: "), F.when(pos, "confirmed").otherwise("rejected"), F.lit(" - "), F.coalesce("v.reason", F.lit("")), F.lit(" ("), F.format_number(conf, 2), F.lit(")"))).otherwise(_C("description"))
    out = j.select(*[x for x in findings.columns], new.alias("_c"), sev.alias("_s"), fp.alias("_f"), layer.alias("_l"), note.alias("_d"))
    return out.select(*[{"confidence": _C("_c"), "severity": _C("_s"), "llm_false_positive": _C("_f"), "layer": _C("_l").cast("int"), "description": _C("_d")}.get(x, _C(x)).alias(x) for x in findings.columns])


#: What each confirmer asks, by the detectors it serves; all others are triaged.
QUESTIONS = {
    "duplicate": (DUPLICATES, "Do these definitions mean the same, so that one shared definition could replace them?"),
    "mutation": (("mutation",), "Does this change a value that its caller still relies on?"),
    "race": (("race-condition",), "Can another task run between the read and the write, so that an update is lost?"),
    "shared-db-write": (("shared-db-write",), "Do these places write the same column without coordinating?"),
    "api-race": (("api-race",), "Can these requests overwrite each other's change of one resource?"),
    "triage": ((), "Is this finding worth a developer's time?"),
}
#: Characters of source beyond which the confirmers of duplicates and mutations are not asked (fixed).
MAX_SOURCE = 2500


def confirmer(detector: Column) -> Column:
    """Name of the confirmer that judges a detector's findings."""
    out = F.lit("triage")
    for name, (detectors, _) in QUESTIONS.items():
        if detectors:
            out = F.when(detector.isin(*detectors), name).otherwise(out)
    return out


def chunk_sites(findings: DataFrame) -> DataFrame:
    """(fingerprint, detector_id, chunk, sites): up to 8 sites in one call, in pairs if their text exceeds the budget."""
    sites = F.slice("evidence", 1, MAX_SITES)
    long_ = F.aggregate(sites, F.lit(0), lambda a, x: a + F.length(F.coalesce(x["snippet"], F.lit("")))) > PROMPT_CHARS
    d = findings.select("fingerprint", "detector_id", long_.alias("long"), F.posexplode(sites).alias("i", "site"))
    chunk = F.when(_C("long"), F.floor(_C("i") / CHUNK_SITES)).otherwise(0).cast("int")
    return d.select("fingerprint", "detector_id", chunk.alias("chunk"), "i", "site").groupBy("fingerprint", "detector_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("i", "site"))).alias("s")).select("fingerprint", "detector_id", "chunk", F.transform("s", lambda x: x["site"]).alias("sites"))


def merge_chunks(chunks: DataFrame, sure: float = 0.7) -> DataFrame:
    """One verdict per fingerprint: positive with the greatest confidence if any chunk is surely so, else the least confident."""
    hit = _C("positive") & (_C("confidence") >= sure)
    g = chunks.groupBy("fingerprint").agg(F.max(F.when(hit, F.struct("confidence", "positive", "reason"))).alias("yes"), F.min(F.struct("confidence", "positive", "reason")).alias("no"))
    v = F.coalesce("yes", "no")
    return g.select("fingerprint", v["positive"].alias("positive"), v["confidence"].alias("confidence"), v["reason"].alias("reason"))


def json_from_reply(text: str | None) -> dict | None:
    """The JSON object of a model's reply: a fence is stripped, else the first balanced braces count."""
    if not text:
        return None
    t = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text.strip())
    try:
        x = json.loads(t)
        return x if isinstance(x, dict) else None
    except ValueError:
        pass
    a = t.find("{")
    while a >= 0:
        depth, quoted, i = 0, False, a
        while i < len(t):
            ch = t[i]
            if quoted:
                i += ch == "\\"
                quoted = ch != '"' or t[i - 1 : i] == "\\" and ch != '"'
            elif ch == '"':
                quoted = True
            else:
                depth += (ch == "{") - (ch == "}")
                if depth == 0:
                    break
            i += 1
        try:
            x = json.loads(t[a : i + 1])
            if isinstance(x, dict):
                return x
        except ValueError:
            pass
        a = t.find("{", a + 1)
    return None


def stub_provider(fingerprint: str, prompt: str) -> str:
    """Deterministic stand-in for a model: confirms longer evidence."""
    sure = min(0.95, 0.5 + len(prompt) / 4000)
    return json.dumps({"positive": sure >= 0.6, "confidence": round(sure, 2), "reason": "length of the evidence"})


def ask(chunks: DataFrame, provider: Callable[[str, str], str] = stub_provider, workers: int = 4) -> DataFrame:
    """(fingerprint, chunk, positive, confidence, reason) of each prompt; any failure leaves no verdict.

    ``workers`` partitions call in parallel; equal prompts are asked once per partition. Each confirmer has its own
    question; duplicates and mutations with more than MAX_SOURCE characters of source are not asked about. If the
    provider fails on a first call of the driver's, nothing is asked at all.
    """
    schema = "fingerprint string, chunk int, positive boolean, confidence double, reason string"
    try:
        provider("", "Answer with {}.")
    except Exception:
        return chunks.sparkSession.createDataFrame([], schema)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, dict | None] = {}
        for pdf in it:
            rows = []
            for fp, chunk, prompt in zip(pdf["fingerprint"], pdf["chunk"], pdf["prompt"]):
                if prompt not in memo:
                    try:
                        memo[prompt] = json_from_reply(provider(fp, prompt))
                    except Exception:
                        memo[prompt] = None
                x = memo[prompt]
                if x and isinstance(x.get("confidence"), int | float) and 0 <= x["confidence"] <= 1 and "positive" in x:
                    rows.append((fp, chunk, bool(x["positive"]), float(x["confidence"]), str(x.get("reason", ""))))
            yield pd.DataFrame(rows, columns=["fingerprint", "chunk", "positive", "confidence", "reason"])

    who = confirmer(_C("detector_id"))
    size = F.aggregate("sites", F.lit(0), lambda a, s: a + F.length(F.coalesce(s["snippet"], F.lit(""))))
    question = F.element_at(F.create_map(*[F.lit(x) for name, (_, q) in QUESTIONS.items() for x in (name, q)]), who)
    text = F.array_join(F.transform("sites", lambda s: F.concat_ws("\n", s["file"], s["snippet"])), "\n---\n")
    asked = chunks.filter(~(who.isin("duplicate", "mutation") & (size > MAX_SOURCE)))
    p = asked.select("fingerprint", "chunk", F.concat_ws("\n\n", question, text).alias("prompt")).repartition(workers)
    return p.mapInPandas(run, schema)


def split_false_positives(findings: DataFrame, fp_set: DataFrame, kept_open: DataFrame) -> DataFrame:
    """Findings with ``bucket`` open or false-positive: kept open wins over the stored set, that over the automatic mark.

    A kept-open finding loses its automatic mark. Findings stored without marks have none.
    """
    if "llm_false_positive" not in findings.columns:
        findings = findings.withColumn("llm_false_positive", F.lit(None).cast("struct<confidence:double,reason:string>"))
    one = lambda d, n: d.select("fingerprint", F.lit(True).alias(n)).distinct()
    j = findings.join(one(fp_set, "_fp"), "fingerprint", "left").join(one(kept_open, "_open"), "fingerprint", "left")
    bucket = F.when(_C("_open"), "open").when(_C("_fp") | _C("llm_false_positive").isNotNull(), "false-positive").otherwise("open")
    mark = F.when(_C("_open").isNull(), _C("llm_false_positive"))
    return j.withColumn("bucket", bucket).withColumn("llm_false_positive", mark).select(*findings.columns, "bucket")
