"""Secret scan with an incremental ledger of blobs.

Every text is addressed by its SHA-256.  The ledger, a table that only grows,
holds for each blob the rule versions that were run on it and the spans they
found.  A scan takes one text of each blob, leaves out the pairs of blob and
rule version that the ledger has, runs the rest, appends the outcome, and joins
the findings back to every row (path, document, version of a file) that holds
the blob.  Copies are removed by an aggregate with a map-side part, so a text
that fills a third of all rows is scanned once and weighs nothing.

Spans are in code points, end exclusive.  Null texts count as empty; an empty
text has no spans; repeated rows get equal rows; an empty table gives an empty
table; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm import words as W

# Patterns, least lengths and order of the base rules.
BASE = ("assign", "access", "hex")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 6
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")

# Added rules: (literal that must occur, pattern).
ADDED = {
    "pem": (b"-----BEGIN ", re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?")),
    "forge": (b"gh", re.compile(rb"\bgh[pousr]_[A-Za-z0-9]{36,}\b")),
    "chat": (b"xox", re.compile(rb"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
}
# Rules whose runs are found from their literal, so that a long run is read once:
# \beyJ[A-Za-z0-9_-]{8,} and two more such runs, joined by stops; \b[a-z][a-z0-9+.-]*://user:password@host.
JWT_RUN = re.compile(rb"[A-Za-z0-9_-]*")
JWT_LEAST = 8
URL_TAIL = re.compile(rb"://[^\s/:@]+:[^\s/:@]+@[^\s/@]+")
URL_SCHEME = b"abcdefghijklmnopqrstuvwxyz0123456789+.-"
URL_START = re.compile(rb"(?<![A-Za-z0-9_])[a-z]")
WORD_BYTE = re.compile(rb"[A-Za-z0-9_]")
VERSIONS = {k: 1 for k in (*BASE, "pem", "jwt", "forge", "chat", "url")}
ORDER = {k: i for i, k in enumerate(VERSIONS)}
SPANS = "array<struct<start:long,rank:int,kind:string,end:long>>"


def _assign(text: bytes) -> list[tuple[int, int]]:
    # a match starts at a keyword: look at those places only, from left to right
    low = text.lower()
    places = set()
    for word in KEYWORDS:
        at = low.find(word)
        while at >= 0:
            places.add(at)
            at = low.find(word, at + 1)
    out, last = [], 0
    for at in sorted(places):
        if at >= last and (m := ASSIGN.match(text, at)):
            last = m.end()
            if len(m[1]) >= ASSIGN_LEAST:
                out.append(m.span())
    return out


def _jwt(text: bytes) -> list[tuple[int, int]]:
    # three whole runs with stops between them; a run is measured once, however many starts it holds
    out, last, at = [], 0, text.find(b"eyJ")
    run = three = -1
    while at >= 0:
        if at >= run:
            run = JWT_RUN.match(text, at).end()
            ends = [run]
            while len(ends) < 3 and text[ends[-1]:ends[-1] + 1] == b".":
                ends.append(JWT_RUN.match(text, ends[-1] + 1).end())
            three = ends[2] if len(ends) == 3 and min(b - a - 1 for a, b in zip(ends, ends[1:])) >= JWT_LEAST else -1
        if at >= last and three >= 0 and run - at - 3 >= JWT_LEAST and not (at and WORD_BYTE.match(text, at - 1)):
            out.append((at, three))
            last = three
            at = text.find(b"eyJ", last)
        else:
            at = text.find(b"eyJ", at + 1)
    return out


def _url(text: bytes) -> list[tuple[int, int]]:
    # the scheme is read back from each ://, over no byte twice
    out, last, at = [], 0, text.find(b"://")
    while at >= 0:
        before = text[last:at]
        scheme = at - (len(before) - len(before.rstrip(URL_SCHEME)))
        m = URL_START.search(text, scheme, at)
        tail = URL_TAIL.match(text, at) if m else None
        if tail:
            out.append((m.start(), tail.end()))
        last = tail.end() if tail else at + 3
        at = text.find(b"://", last)
    return out


def find(kind: str, text: bytes) -> list[tuple[int, int]]:
    """Byte spans of one rule, leftmost and non-overlapping."""
    if kind == "assign":
        return _assign(text)
    if kind == "access":
        return [m.span() for m in ACCESS.finditer(text)] if b"AKIA" in text else []
    if kind == "hex":
        return [m.span() for m in HEX.finditer(text)]
    if kind in ("jwt", "url"):
        return (_jwt if kind == "jwt" else _url)(text)
    literal, pattern = ADDED[kind]
    return [m.span() for m in pattern.finditer(text)] if literal in text else []


def spans_of(text: bytes, kinds) -> list[dict]:
    """Spans of the rules in code points, by start, then in rule order."""
    found = [(a, ORDER[k], k, b) for k in kinds for a, b in find(k, text)]
    point = {}
    at = n = 0
    for p in sorted({x[0] for x in found} | {x[3] for x in found}):
        n += len(text[at:p].decode("utf-8", "replace"))
        point[p], at = n, p
    return [{"start": point[a], "rank": r, "kind": k, "end": point[b]} for a, r, k, b in sorted(found)]


_OUT = pa.schema([("blob", pa.string()), ("rules", pa.list_(pa.string())),
                  ("spans", pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64())])))])


def _scan(batches):
    for batch in batches:
        data, off = W.text_buffer(batch.column("text"))
        rules = batch.column("rules").to_pylist()
        spans = []
        for i, todo in enumerate(rules):
            spans.append(spans_of(data[off[i]:off[i + 1]].tobytes(), [r.split("@")[0] for r in todo]))
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(rules, _OUT.field(1).type),
                                          pa.array(spans, _OUT.field(2).type)], schema=_OUT)


def _known(spark, ledger: str) -> DataFrame:
    try:
        return spark.read.parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"blob string, rules array<string>, spans {SPANS}")


def _held(docs: DataFrame) -> DataFrame:
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return held.withColumn("blob", F.sha2("text", 256))


def update(docs: DataFrame, ledger: str, versions: dict[str, int] = VERSIONS) -> None:
    """Scan what ``ledger`` (a folder all executors share) lacks of the blobs of ``docs``, and append it."""
    rules = F.array(*[F.lit(f"{k}@{v}") for k, v in versions.items()])
    done = _known(docs.sparkSession, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
    todo = (_held(docs).groupBy("blob").agg(F.any_value("text").alias("text")).join(done, "blob", "left")
            .withColumn("rules", F.array_except(rules, F.coalesce("done", F.array().cast("array<string>"))))
            .where("size(rules) > 0").select("blob", "text", "rules"))
    todo.mapInArrow(_scan, f"blob string, rules array<string>, spans {SPANS}").write.mode("append").parquet(ledger)


def scan(docs: DataFrame, ledger: str, versions: dict[str, int] = VERSIONS) -> DataFrame:
    """(doc_id, blob, spans) of every row, after scanning what ``ledger`` lacks."""
    update(docs, ledger, versions)
    wanted = docs.sparkSession.read.parquet(ledger).select("blob", "rules", F.explode("spans").alias("s"))
    # a ledger row names the versions that found its spans: only those of the current ones count
    current = F.create_map(*[F.lit(x) for k, v in versions.items() for x in (k, f"{k}@{v}")])
    wanted = wanted.where(F.array_contains("rules", current[F.col("s.kind")])).groupBy("blob").agg(
        F.array_sort(F.collect_set("s")).alias("spans"))  # the spans of one text
    return _held(docs).select("doc_id", "blob").join(wanted, "blob", "left").select(
        "doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query from the rows of ``scan``."""
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(text(base), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))


def new_ledger(root: str) -> str:
    """Folder for a ledger of its own under ``root``."""
    return f"{root.rstrip('/')}/ledger-{uuid.uuid4().hex}"
