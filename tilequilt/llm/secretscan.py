"""Secret scanning with DataFrame functions only: fixed patterns, and a battery of randomness tests.

Candidates are maximal runs of base64-like characters with a letter and a digit that no pattern has found. For the
encoding inferred from a run's characters, three tests of the hypothesis that it is uniformly random are made
(chi-squared uniformity over the alphabet, runs about the alphabet's middle, lag-one serial correlation) and combined
by Fisher's method. Random runs have uniform p-values, others small ones; so within each stratum of encoding and
length, the number of random runs is estimated from the p-values over a half, and the least threshold is taken at
which the estimated share of false ones among the runs above it is at most FALSE_SHARE. Equal runs count once. A
stratum of fewer than LEAST_RUNS runs borrows what it lacks from others of its encoding, those from all others, and those from
PRIOR, so that every stratum has a threshold, even that of a corpus with a single run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of these patterns are maximal, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGN = 12
#: A run with one of + / and one of - _ fits no encoding as a whole (such as the path of a URL); its pieces between / are tested.
MIXED, PIECE = r"^(?=.*[+/])(?=.*[_-])", r"[A-Za-z0-9+_-]{20,}={0,2}"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings in the order of inference: what a run must look like, and its alphabet.
ENCODINGS = (
    ("hex", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + "234567"),
    ("alnum", r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", r"^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", r"^[A-Za-z0-9+_-]+=*$", UPPER + LOWER + DIGITS + "+-_"),
)
FALSE_SHARE = 0.1
BINS = 64
#: Distinct runs that a stratum's threshold is taken from at least; fewer borrow the others.
LEAST_RUNS = 64
#: Shares of the bins where nothing is known: half of the runs random (any p alike), half not (p in the lowest bin).
PRIOR = [0.5 / BINS + (0.5 if b == 0 else 0.0) for b in range(BINS)]
#: Strata of length: up to 31, 63, 127, 255 and beyond.
LENGTHS = (32, 64, 128, 256)
#: Items that are gone through together, so that work on n matches of a text doesn't grow with n squared but n * (BLOCK + n / BLOCK).
BLOCK = 256


def _once(value: Column, use) -> Column:
    """use(value), with value made once: in a lambda an expression of columns would be made anew for each item."""
    return F.transform(F.array(value), use)[0]


def _blocks(items: Column) -> Column:
    """items, bound by _once, in runs of BLOCK; one empty run if there are none."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / BLOCK).cast("int") - 1, F.lit(0))), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))


def spans(text: Column, pattern: str, kind: str, order: int, least: int = 0, group: int = 0) -> Column:
    """array<struct<start, ord, stop, kind, value>> of the matches of pattern, by code points; group at least that long.

    Java's split gives the pieces between matches, so starts are running sums of the lengths of pieces and matches,
    taken within blocks and then over them, as each step of a fold copies the list that it has so far.
    """
    if least:
        parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"), F.split(text, pattern, -1).alias("p"))
    else:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        parts = F.arrays_zip(found.alias("m"), found.alias("g"), F.split(text, pattern, -1).alias("p"))
    kind_type = "array<struct<start:int,ord:int,stop:int,kind:string,value:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind_type).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        stop = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), stop.alias("stop"), F.lit(kind).alias("kind"), x["m"].alias("value"))
        keep = x["m"].isNotNull() & (F.length(x["g"]) >= least)
        return F.struct(stop.alias("at"), F.when(keep, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def follow(acc: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda x: x.withField("start", x["start"] + acc["at"]).withField("stop", x["stop"] + acc["at"]))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.array_append(acc["out"], moved).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind_type}>").alias("out"))
    blocks = _once(parts, lambda x: F.transform(_blocks(x), lambda b: F.aggregate(b, zero, step)))
    made = F.flatten(F.aggregate(blocks, none, follow, lambda acc: acc["out"]))
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast(kind_type))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, each leftmost and non-overlapping, by start and then kind as listed."""
    return F.array_sort(F.concat(spans(text, ASSIGN, "assign", 0, LEAST_ASSIGN, 2), spans(text, ACCESS, "access", 1), spans(text, HEX, "hex", 2)))


def pieces(run: Column) -> Column:
    """The spans of a run to be tested: itself, or its long pieces between / if it is MIXED."""
    moved = F.transform(spans(run["value"], PIECE, "random", 3), lambda s: s.withField("start", s["start"] + run["start"]).withField("stop", s["stop"] + run["start"]))
    return F.when(run["value"].rlike(MIXED), moved).otherwise(F.array(run))


def free_runs(text: Column, base: Column) -> Column:
    """Spans of candidate runs with a letter and a digit that touch no base span."""
    every = F.flatten(F.transform(spans(text, RUN, "random", 3), pieces))
    runs = F.filter(every, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))

    def touched(s: Column, spans_: Column) -> Column:
        return F.exists(spans_, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))

    ranged = _once(base, lambda x: F.transform(_blocks(x), lambda b: F.struct(F.array_min(F.transform(b, lambda y: y["start"])).alias("start"), F.array_max(F.transform(b, lambda y: y["stop"])).alias("stop"), b.alias("spans"))))
    free = _once(ranged, lambda x: F.filter(runs, lambda s: ~F.exists(x, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]) & touched(s, b["spans"]))))
    return F.when(F.size(base) > 0, free).otherwise(runs)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, to about 1e-4 (logistic approximation)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * normal_tail(F.abs(z)))


def encoding(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern, _ in reversed(ENCODINGS):
        out = F.when(value.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _alphabet(name: Column) -> Column:
    out = F.lit(ENCODINGS[-1][2])
    for n, _, letters in reversed(ENCODINGS[:-1]):
        out = F.when(name == n, F.lit(letters)).otherwise(out)
    return out


def _with(items: Column, kept: tuple[str, ...], **more) -> Column:
    """items with only the fields kept and more ones, each made of the run; a step by itself, so nothing is made twice."""
    return F.transform(items, lambda r: F.struct(*(r[k].alias(k) for k in kept), *(f(r).alias(k) for k, f in more.items())))


def _sum(codes: Column, of) -> Column:
    return F.aggregate(codes, F.lit(0.0), lambda acc, x: acc + of(x))


def _runs_p(r: Column) -> Column:
    """Two-sided p of the number of runs below and above the alphabet's middle; 0.000001 if there is but one kind."""
    mean = 2 * r["high"] * (r["n"] - r["high"]) / r["n"] + 1
    var = (mean - 1) * (mean - 2) / (r["n"] - 1)
    return F.when(var <= 0, F.lit(1e-6)).otherwise(_two_sided((r["changes"] + 1 - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))))


def tests(runs: Column) -> Column:
    """array<struct<span, encoding>> -> array<struct<span, encoding, n, uniform, runs, serial, p>>.

    p is Fisher's combination of the three p-values of a run under its encoding.
    """
    own = ("span", "encoding")
    x = _with(runs, own, letters=lambda r: _alphabet(r["encoding"]), chars=lambda r: F.split(F.rtrim(r["span"]["value"], F.lit("=")), ""))
    x = _with(x, own, letters=lambda r: r["letters"], codes=lambda r: F.transform(r["chars"], lambda c: F.instr(r["letters"], c).cast("double") - 1))
    x = _with(x, (*own, "codes"), size=lambda r: F.length(r["letters"]).cast("double"), n=lambda r: F.size(r["codes"]).cast("double"))
    x = _with(x, (*own, "codes", "size", "n"), nexts=lambda r: F.zip_with(F.slice(r["codes"], F.lit(1), F.size(r["codes"]) - 1), F.slice(r["codes"], F.lit(2), F.size(r["codes"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    kept = (*own, "codes", "size", "n", "nexts")
    x = _with(
        x,
        kept,
        squares=lambda r: _sum(F.sequence(F.lit(0), r["size"].cast("int") - 1), lambda i: F.pow(F.size(F.filter(r["codes"], lambda c: c == i)).cast("double"), 2)),
        high=lambda r: _sum(r["codes"], lambda c: (c >= r["size"] / 2).cast("double")),
        changes=lambda r: _sum(r["nexts"], lambda y: ((y["a"] >= r["size"] / 2) != (y["b"] >= r["size"] / 2)).cast("double")),
        mean=lambda r: _sum(r["codes"], lambda c: c) / r["n"],
    )
    kept = (*own, "size", "n", "squares", "high", "changes")
    x = _with(
        x,
        kept,
        spread=lambda r: _sum(r["codes"], lambda c: (c - r["mean"]) * (c - r["mean"])),
        lagged=lambda r: _sum(r["nexts"], lambda y: (y["a"] - r["mean"]) * (y["b"] - r["mean"])),
    )
    kept = (*own, "n")
    x = _with(
        x,
        (*kept, "size"),
        chi=lambda r: F.greatest(r["squares"] * r["size"] / r["n"] - r["n"], F.lit(1e-9)) / (r["size"] - 1),
        var=lambda r: 2 / (9 * (r["size"] - 1)),
        runs=_runs_p,
        serial=lambda r: F.when(r["spread"] <= 0, F.lit(1e-6)).otherwise(_two_sided((r["lagged"] / F.greatest(r["spread"], F.lit(1e-9)) + 1 / r["n"]) * F.sqrt(r["n"]))),
    )
    x = _with(x, (*kept, "runs", "serial"), uniform=lambda r: normal_tail((F.pow(r["chi"], 1 / 3) - 1 + r["var"]) / F.sqrt(r["var"])))
    logs = lambda r: -sum((F.log(F.greatest(r[k], F.lit(1e-12))) for k in ("uniform", "runs", "serial")), F.lit(0.0))
    kept = (*kept, "uniform", "runs", "serial")
    x = _with(x, kept, logs=logs)
    return _with(x, kept, p=lambda r: F.exp(-r["logs"]) * (1 + r["logs"] + r["logs"] * r["logs"] / 2))


def stratum(name: Column, n: Column) -> Column:
    """encoding/length class, as text: at most len(ENCODINGS) * (len(LENGTHS) + 1) values."""
    at = F.lit(len(LENGTHS))
    for i, most in reversed(list(enumerate(LENGTHS))):
        at = F.when(n < most, F.lit(i)).otherwise(at)
    return F.concat_ws("/", name, at.cast("string"))


def _filled(counts: list[float], others: list[float]) -> list[float]:
    """counts, made up to LEAST_RUNS by the shares of others."""
    lack = max(0.0, LEAST_RUNS - sum(counts)) / sum(others)
    return [c + lack * o for c, o in zip(counts, others, strict=True)]


def least_p(counts: list[float], share: float = FALSE_SHARE) -> float:
    """Least p of a random run, of the numbers of runs by bin of p.

    With m0 random ones estimated as twice the count of p over 1/2, the share of others among those at t and above is
    1 - m0 (1 - t) / count; the least t of the grid 0, 1 / BINS ... 1/2 with a share of at most `share` is taken. Where
    none of the grid has a run at or above it, infinity: there is nothing to take.
    """
    m0 = 2 * sum(counts[BINS // 2 :])
    for at in range(BINS // 2 + 1):
        above = sum(counts[at:])
        if above > 0 and 1 - m0 * (1 - at / BINS) / above <= share:
            return at / BINS
    return math.inf


def thresholds(tested: DataFrame, share: float = FALSE_SHARE) -> dict[str, float]:
    """Least p of a random run by stratum, of tested (stratum, run, p); rows of the same run count once.

    Only the counts by stratum and bin, bounded by the number of strata, reach the driver.
    """
    distinct = tested.select("stratum", F.xxhash64("run").alias("run"), "p").groupBy("stratum", "run").agg(F.min("p").alias("p"))
    binned = distinct.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("p") * BINS)).cast("int")).groupBy("stratum", "bin").count()
    own: dict[str, list[float]] = {}
    for r in binned.collect():
        own.setdefault(r["stratum"], [0.0] * BINS)[r["bin"]] += r["count"]
    def total(names: list[str]) -> list[float]:
        return [sum(x) for x in zip([0.0] * BINS, *(own[k] for k in names), strict=True)]

    out = {}
    for name, counts in own.items():
        kin = [k for k in own if k != name and k.split("/")[0] == name.split("/")[0]]
        rest = [k for k in own if k != name and k not in kin]
        out[name] = least_p(_filled(counts, _filled(total(kin), _filled(total(rest), PRIOR))), share)
    return out


def _tested(text: Column, base: Column) -> Column:
    """The candidate runs with their strata and tests."""
    runs = F.transform(free_runs(text, base), lambda s: F.struct(s.alias("span"), encoding(s["value"]).alias("encoding")))
    known = F.filter(runs, lambda r: r["encoding"].isNotNull())
    return F.transform(tests(known), lambda r: F.struct(r["span"].alias("span"), stratum(r["encoding"], r["n"]).alias("stratum"), r["p"].alias("p")))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, random) of every row of docs (doc_id, text): arrays of struct<start, ord, stop, kind, value>.

    base: spans of the fixed kinds; random: runs that the battery takes for random, which touch none of base. The
    corpus is read twice: p-values by stratum are counted over all documents, then all are scanned with the thresholds
    that follow. Where a stratum of LEAST_RUNS runs or more has no p over a half, none of its runs is taken. A null text is empty; null ids pass;
    repeated rows each come back; an empty table gives an empty one; extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text.alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    hopeful = F.col("text").rlike(RUN)
    none = F.array().cast("array<struct<span:struct<start:int,ord:int,stop:int,kind:string,value:string>,stratum:string,p:double>>")
    rows = rows.withColumn("tested", F.when(hopeful, _tested(F.col("text"), F.col("base"))).otherwise(none))
    least = thresholds(rows.select(F.explode("tested").alias("x")).select("x.stratum", F.col("x.span.value").alias("run"), "x.p"))
    limit = F.create_map(*(F.lit(x) for k, v in sorted(least.items()) for x in (k, v))) if least else F.create_map().cast("map<string,double>")
    taken = F.filter("tested", lambda x: x["p"] >= F.coalesce(F.element_at(limit, x["stratum"]), F.lit(math.inf)))
    return rows.select("doc_id", "base", F.transform(taken, lambda x: x["span"]).alias("random"))


def joined(spans_: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of every row; see scan_secrets."""
    found = scan_secrets(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    every = F.array_sort(F.concat("base", "random"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("random").cast("long").alias("n_random"))
