"""Secret scans in native Spark SQL: base patterns plus sliding-window entropy.

Places of matches come from splitting a text by the pattern that also extracts
the matches: lengths of gaps and matches alternate, and their running sum is
the place.  Everything is a projection over one row; nothing is shuffled.

Entropy: a candidate is a run of 20 or more of ``[A-Za-z0-9+/_=-]`` with a letter
and a digit.  A window of 20 characters slides over it.  The state holds how
often each character is in the window and the sum of c * log2(c); one step adds
the entering and takes the leaving character.  H = log2(20) - sum / 20.  The
greatest H is held against the threshold of the candidate's character class.
All of it takes time in proportion to the text, up to the logarithm of the
number of matches.
Base spans and segments (between ``= - _ /``) with a placeholder's word are taken
out of a run first; what is left of it stands for itself. Where a run as a whole
adds nothing, each of its segments is judged as if it stood alone, so that a name
joined to a secret changes neither its class nor its place in the allow list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

# Kinds in their order, base patterns, least lengths.
KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SEGMENT = r"[A-Za-z0-9+]{20,}"
# Bits of entropy in 20 characters from which a candidate counts, by class.
THRESHOLD = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
WINDOW = 20
# What the allow list suppresses: UUIDs, placeholders, counted-up digits, identifiers joined of plain words.
PLACEHOLDER = "example|sample|placeholder|changeme|dummy|xxxx|0123456789|1234567890"
ALLOW = rf"(?i:^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$|{PLACEHOLDER}|^[a-z]++(?:[-_/=][a-z]++)*+[-_/=]?[0-9]{{1,4}}$)"
#: A whole segment with a placeholder's word and what parts it from others; begins at their begin only, so the search is linear.
PLACEHOLDER_SEGMENT = rf"(?:(?<![-_/=])[-_/=]+)?(?<![A-Za-z0-9+])[A-Za-z0-9+]*?(?i:{PLACEHOLDER})[A-Za-z0-9+]*[-_/=]*"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SPAN = "array<struct<start:int,kind:int,end:int>>"
PIECE = 4096


def _none() -> Column:
    return F.array().cast(_SPAN)


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once, also where use has it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(sizes: Column) -> Column:
    """Sums of sizes up to each place: each round adds what lies twice as far back, so n elements take log2(n) rounds."""
    rounds = F.slice(F.sequence(F.lit(0), F.lit(31)), F.lit(1), F.length(F.bin(F.size(sizes))))

    def step(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0)))

    return F.aggregate(rounds, sizes, step)


def _located(text: Column, pattern: str, kind: int) -> Column:
    """All matches in order as (start, kind, end) in code points, the end exclusive."""
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.struct(gaps.alias("gaps"), sizes.alias("sizes"))

    def spans(b: Column) -> Column:
        ends = _running(F.transform(b["sizes"], lambda n, i: n + F.get(b["gaps"], i)))
        place = lambda e, n: F.struct((e - n).alias("start"), F.lit(kind).alias("kind"), e.alias("end"))
        return F.zip_with(ends, b["sizes"], place)

    return _bound(both, spans)


def _base(text: Column) -> Column:
    found = []
    for kind, (name, pattern, guard) in enumerate((("assign", ASSIGN, r"""(?i:word|passwd|secret|token|key)["']?\x20*[:=]"""), ("access", ACCESS, "AKIA[A-Z0-9]{14}"), ("hex", "[0-9a-f]{16,}", "[0-9a-f]{16}"))):
        spans = _located(text, pattern, kind)
        if name == "assign":  # whole matches first, so that a failing one still uses up its text
            values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
            spans = F.transform(F.filter(F.arrays_zip(spans.alias("s"), F.transform(values, F.length).alias("n")), lambda x: x["n"] >= LEAST["assign"]), lambda x: x["s"])
        elif name == "access":
            spans = F.filter(spans, lambda x: x["end"] - x["start"] >= LEAST["access"])
        found.append(F.when(text.rlike(guard), spans).otherwise(_none()))
    return F.array_sort(F.concat(*found))


def max_window_entropy(s: Column, window: int = WINDOW) -> Column:
    """The greatest Shannon entropy, in bits, of any window of s, a text of candidate characters; by incremental counts.

    The state is one letter for each character's count in the window, and the
    sum of c * log2(c) in 2**-40 bits; a step changes two letters, so time is
    linear in the length of s.
    """
    unit = float(1 << 40)
    plogp = F.array(*[F.lit(round(c * math.log2(c) * unit) if c else 0).cast("long") for c in range(window + 2)])
    start = F.struct(F.lit("a" * (len(_ALPHABET) + 1)).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(1 << 62).cast("long").alias("least"))
    place = lambda c: F.call_function("locate", c, F.lit(_ALPHABET)) + 1
    count = lambda n, c: F.ascii(F.substring(n, place(c), F.lit(1))) - ord("a")
    put = lambda n, c, x: F.overlay(n, F.char(x + ord("a")), place(c), F.lit(1))

    def slide(chars: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            come, go = F.get(chars, i), F.get(chars, i - window)  # none goes before the window is full
            up, down = count(acc["n"], come), count(acc["n"], go)
            entered, n = acc["sum"] + F.get(plogp, up + 1) - F.get(plogp, up), put(acc["n"], come, up + 1)
            left = entered + F.get(plogp, down - 1) - F.get(plogp, down)
            least = F.when(i >= window, F.least(acc["least"], acc["sum"])).otherwise(acc["least"])  # the window that ended before i
            return F.struct(
                F.when(go.isNull(), n).when(come == go, acc["n"]).otherwise(put(n, go, down - 1)).alias("n"),
                F.when(go.isNull(), entered).when(come == go, acc["sum"]).otherwise(left).alias("sum"), least.alias("least"),
            )

        end = lambda acc: math.log2(window) - F.least(acc["least"], acc["sum"]) / (window * unit)
        return F.when(F.size(chars) >= window, F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, end)).otherwise(F.lit(0.0))

    return _bound(F.split(s, ""), slide)


def _rebuilt(text: Column, spans: Column, instead) -> Column:
    """text with instead(span) for each span; spans by start, not overlapping. Cut from pieces of PIECE characters, so in linear time."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(chunks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        head = F.substring(F.coalesce(F.get(chunks, i), F.lit("")), (a - i * PIECE + 1).cast("int"), F.when(i == j, b - a).otherwise(F.lit(PIECE)).cast("int"))
        tail = F.substring(F.coalesce(F.get(chunks, j), F.lit("")), F.lit(1), (b - j * PIECE).cast("int"))
        return F.when(i == j, head).otherwise(F.concat(head, F.when(j > i + 1, F.array_join(F.slice(chunks, i + 2, j - i - 1), "")).otherwise(""), tail))

    def build(h: Column) -> Column:
        kept = F.transform(h["spans"], lambda x, k: F.concat(between(h["chunks"], F.coalesce(F.get(h["spans"], k - 1)["end"], F.lit(0)), x["start"]), instead(x)))
        last = F.coalesce(F.get(h["spans"], F.size(h["spans"]) - 1)["end"], F.lit(0))
        return F.concat(F.array_join(kept, ""), between(h["chunks"], last, h["n"]))

    return _bound(F.struct(spans.alias("spans"), pieces.alias("chunks"), F.length(text).alias("n")), build)


def _apart(spans: Column) -> Column:
    """Spans, sorted by start, cut to what none before them has, and those of which nothing is left taken out; one mark each stays.

    reach is the running maximum of the ends, by rounds as in _running.
    """

    def cut(x: Column) -> Column:
        rounds = F.slice(F.sequence(F.lit(0), F.lit(31)), F.lit(1), F.length(F.bin(F.size(x))))
        most = lambda acc, k: F.transform(acc, lambda e, i: F.greatest(e, F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))))
        reach = F.aggregate(rounds, F.transform(x, lambda s: s["end"]), most)
        begun = lambda r: F.transform(x, lambda s, i: F.struct(F.greatest(s["start"], F.coalesce(F.get(r, i - 1), F.lit(0))).alias("start"), (s["start"] < F.coalesce(F.get(r, i - 1), F.lit(0))).alias("joined"), s["end"].alias("end")))
        return F.filter(_bound(reach, begun), lambda s: s["end"] > s["start"])

    return _bound(spans, cut)


def _masked(text: Column, spans: Column) -> Column:
    """text with a space for each character of spans."""
    blank = lambda x: F.repeat(F.lit(" "), x["end"] - x["start"])
    return _bound(spans, lambda s: F.when(F.size(s) > 0, _rebuilt(text, _apart(s), blank)).otherwise(text))


def _judged(masked: Column, pattern: str) -> Column:
    """Spans of the pattern's matches of high entropy."""
    spans, runs = _located(masked, pattern, KINDS.index("entropy")), F.regexp_extract_all(masked, F.lit(pattern), F.lit(0))
    limit = lambda r: F.when(r.rlike("^[0-9A-Fa-f]+$"), THRESHOLD["hex"]).when(r.rlike("^[0-9A-Za-z]+$"), THRESHOLD["alnum"]).otherwise(THRESHOLD["base64"])
    likely = lambda r: r.rlike("[A-Za-z]") & r.rlike("[0-9]") & ~r.rlike(ALLOW)
    kept = F.filter(F.arrays_zip(spans.alias("s"), runs.alias("run")), lambda x: F.when(likely(x["run"]), max_window_entropy(x["run"]) >= limit(x["run"])).otherwise(False))
    return F.when(masked.rlike(pattern), F.transform(kept, lambda x: x["s"])).otherwise(_none())


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(documents: DataFrame, base: str = "_base", spans: str = "_spans") -> DataFrame:
    """All columns of documents, plus base and spans: arrays of (start, kind, end), by start, then kind.

    A null text counts as empty; nothing is shuffled, so repeated rows and ties
    need no rule; other columns pass through. base and spans must be new names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    masked, runs, left = unused([*documents.columns, base, spans], "_masked", "_runs", "_left")
    held = F.when(text.rlike(f"(?i:{PLACEHOLDER})"), _located(text, PLACEHOLDER_SEGMENT, 0)).otherwise(_none())
    known = F.when(text.rlike(CANDIDATE), F.array_sort(F.concat(F.col(base), held))).otherwise(_none())
    whole = documents.withColumn(base, _base(text)).withColumn(masked, _masked(text, known)).withColumn(runs, _judged(F.col(masked), CANDIDATE))
    parts = whole.withColumn(left, _masked(F.col(masked), F.col(runs)))  # a run that counts as a whole is not judged by segments again
    return parts.withColumn(spans, F.array_sort(F.concat(base, runs, _judged(F.col(left), SEGMENT)))).drop(masked, runs, left)


def digests(documents: DataFrame) -> DataFrame:
    """One row per row of documents: counts of the base kinds and digests of the spans."""
    number = lambda kind: F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long")
    return scan(documents.select("doc_id", "text")).select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"),
    )


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """documents with each maximal run of overlapping spans replaced by mark; n_chars, where present, follows.

    A null text stays null. Columns of any name pass through.
    """
    base, spans = unused(documents.columns, "_base", "_spans")
    text = F.col("text")
    clean = _rebuilt(text, _apart(F.col(spans)), lambda x: F.when(x["joined"], "").otherwise(mark))
    out = scan(documents, base, spans).withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(text))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(base, spans)


#: The base spans' counts, which SQL can say.
BASE_ORACLE = r"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text,''), '((?i:password|passwd|secret|token|api_?key))["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce(text,''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(coalesce(text,''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_hex
FROM documents
"""
