"""Secret scans with a randomness test battery, in DataFrame functions only.

Fixed patterns give the base spans. Beyond them, every long run of key characters is a candidate. Its encoding is inferred from its characters, and a battery
of chi-squared uniformity over that alphabet, runs about its middle and lag-1 serial correlation is read twice.

Against randomness: the three p-values are combined (Fisher), and a run that isn't random by them is never a finding.

Against text: the null hypothesis is that characters are drawn independently with the shares that they have in running text. Under it each test has a p-value for looking as
random as the run does (chi-squared: as few repeats, runs: as many runs, serial: a correlation as near 0); p is calibrated to the e-value 1 / (2 sqrt(p)). Their mean with the likelihood ratio
of uniform characters over running text, divided by the number of encodings among which one was chosen, has an expectation of 1 at most, so it is an e-value too.
Findings follow the weighted e-BH rule over all candidates of all texts as one family: with weights in proportion to length, the expected share of false
findings is at most FALSE_DISCOVERIES whatever the dependence between candidates. The p-values use normal approximations, and are not taken below LEAST_P.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import stored

#: Pattern, group whose length counts, least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": (ASSIGN, 1, 12), "access": ("AKIA[A-Z0-9]+", 0, 18), "hex": ("[0-9a-f]{16,}", 0, 16)}
KINDS = (*BASE, "random")
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
FALSE_DISCOVERIES, LEAST_RANDOM, LEAST_P = 0.01, 0.001, 1e-6
#: A candidate's weight is its length, up to this one. Evidence is kept in quarters of a bit, up to this many bits.
LONGEST_WEIGHT, MOST_BITS = 64, 1000
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings in the order tried: name, pattern of the whole run without padding, alphabet.
ENCODINGS = (
    ("digits", "[0-9]+", _DIGITS),
    ("hex", "[0-9a-f]+", _DIGITS + "abcdef"),
    ("hex-upper", "[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("lower", "[a-z]+", _LOWER),
    ("upper", "[A-Z]+", _UPPER),
    ("base32", "[A-Z2-7]+", _UPPER + "234567"),
    ("base36", "[a-z0-9]+", _LOWER + _DIGITS),
    ("base62", "[A-Za-z0-9]+", _UPPER + _LOWER + _DIGITS),
    ("base64", "[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_"),
    ("mixed", ".+", _UPPER + _LOWER + _DIGITS + "+/-_="),
)
#: Letters of English text, in thousandths, from a to z.
_TEXT = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
#: Shares of characters in running text; they sum to 1.
SHARES = {c: 0.90 * n / 1003 for c, n in zip(_LOWER, _TEXT, strict=True)} | {c: 0.05 * n / 1003 for c, n in zip(_UPPER, _TEXT, strict=True)} | dict.fromkeys(_DIGITS, 0.003) | dict.fromkeys("+/_=-", 0.004)


def text_moments(alphabet: str) -> tuple[float, float, float]:
    """Of text's characters, given that they are of this alphabet: the chances that two and three are equal, and that one is in the alphabet's upper half."""
    total = sum(SHARES[c] for c in alphabet)
    q = [SHARES[c] / total for c in alphabet]
    return sum(x**2 for x in q), sum(x**3 for x in q), sum(x for k, x in enumerate(q) if 2 * k >= len(alphabet))


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value made once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(values: Column) -> Column:
    """Running sums of an array in log2(size) passes over it: pass k adds the sum that stands 2^k places before. (A fold that appends would copy the array each time.)"""

    def added(step: int) -> Callable[[Column], Column]:
        return lambda xs: F.when(F.size(xs) > step, F.transform(xs, lambda v, i: v + F.when(i >= step, F.get(xs, i - step)).otherwise(0))).otherwise(xs)

    return reduce(lambda xs, k: _with(xs, added(1 << k)), range(31), values)


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """[(start, rank, kind, end, found)] of all leftmost non-overlapping matches, by code point.

    Each piece reaches from the end of one match to the end of the next, so the running sum of lengths gives the position. \\G keeps the search linear.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0))

    def one(piece: Column, end: Column) -> Column:
        found = F.regexp_extract(piece, rf"(?:{pattern})\z", 0)
        counted = F.length(found if not group else F.regexp_extract(piece, rf"(?:{pattern})\z", group))
        return F.struct((end - F.length(found)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), found.alias("found"), (counted >= least).alias("long"))

    def placed(ps: Column) -> Column:
        return _with(_running(F.transform(ps, F.length)), lambda ends: F.transform(ps, lambda p, i: one(p, F.get(ends, i))))

    names = ("start", "rank", "kind", "end", "found")
    return F.transform(F.filter(_with(pieces, placed), lambda s: s["long"]), lambda s: F.struct(*[s[k].alias(k) for k in names]))


def _normal(z: Column) -> Column:
    """Distribution function of the normal law (logistic approximation, off by less than 0.0002)."""
    return 1 / (1 + F.exp(-F.least(F.greatest(1.5976 * z + 0.07056 * F.pow(z, F.lit(3.0)), F.lit(-300.0)), F.lit(300.0))))


def _encoding(token: Column) -> Column:
    """alphabet and moments of the first encoding that has all characters of a run."""
    value = [F.struct(F.lit(a).alias("alphabet"), *[F.lit(x).alias(n) for n, x in zip(("two", "three", "high"), text_moments(a), strict=True)]) for *_, a in ENCODINGS]
    return reduce(lambda rest, e: F.when(token.rlike(rf"\A(?:{e[0]})\z"), e[1]).otherwise(rest), reversed([(p, v) for (_, p, _), v in zip(ENCODINGS, value, strict=True)]), F.lit(None))


def _tested(candidates: Column) -> list[tuple[str, Column]]:
    """Steps that turn candidate spans into (start, rank, kind, end, weight, evidence): evidence (bits of e-value times weight), or null where a run isn't random."""
    by_code = F.array(*[F.lit(SHARES.get(chr(c), 1.0)) for c in range(128)])

    def letters(c: Column) -> Column:
        unpadded = F.rtrim(c["found"], F.lit("="))
        body = F.when(unpadded == "", c["found"]).otherwise(unpadded)
        return _with(body, lambda b: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.filter(F.split(b, ""), lambda x: x != "").alias("chars"), _encoding(b).alias("e")))

    def coded(c: Column) -> Column:
        x = F.transform(c["chars"], lambda ch: F.instr(c["e"]["alphabet"], ch) - 1)
        a = F.length(c["e"]["alphabet"]).cast("double")
        bits = F.aggregate(c["chars"], F.lit(0.0), lambda acc, ch: acc - F.log2(a * F.get(by_code, F.ascii(ch))))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["e"].alias("e"), a.alias("a"), x.alias("x"), bits.alias("bits"))

    def summed(c: Column) -> Column:
        n = F.size(c["x"]).cast("double")
        start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("same"), F.lit(0.0).alias("pairs"))

        def met(acc: Column, v: Column) -> Column:
            same = F.when(acc["last"] == v, acc["same"] + 1).otherwise(F.lit(0.0))
            return F.struct(v.cast("int").alias("last"), same.alias("same"), (acc["pairs"] + same).alias("pairs"))

        pairs = F.aggregate(F.array_sort(c["x"]), start, met, lambda acc: acc["pairs"])
        mean = F.aggregate(c["x"], F.lit(0.0), lambda acc, v: acc + v) / n
        high = F.aggregate(c["x"], F.lit(0.0), lambda acc, v: acc + F.when(2 * v >= c["a"], 1.0).otherwise(0.0))
        return F.struct(*[c[k].alias(k) for k in ("start", "end", "e", "x", "bits", "a")], n.alias("n"), pairs.alias("pairs"), mean.alias("mean"), high.alias("high"))

    def walked(c: Column) -> Column:
        start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("cross"), F.lit(0.0).alias("own"))

        def step(acc: Column, v: Column) -> Column:
            turned = (acc["last"] < 0) | ((2 * acc["last"] >= c["a"]) != (2 * v >= c["a"]))
            cross = F.when(acc["last"] < 0, 0.0).otherwise((acc["last"] - c["mean"]) * (v - c["mean"]))
            return F.struct(v.cast("int").alias("last"), (acc["runs"] + F.when(turned, 1.0).otherwise(0.0)).alias("runs"), (acc["cross"] + cross).alias("cross"), (acc["own"] + (v - c["mean"]) * (v - c["mean"])).alias("own"))

        return F.struct(*[c[k].alias(k) for k in ("start", "end", "e", "bits", "a", "n", "pairs", "high")], F.aggregate(c["x"], start, step).alias("w"))

    def judged(c: Column) -> Column:
        n, df, high, runs = c["n"], c["a"] - F.lit(1.0), c["high"], c["w"]["runs"]
        low = n - high
        # Against randomness.
        chi = F.pow((c["a"] * (2 * c["pairs"] + n) / n - n) / df, F.lit(1 / 3))
        chi = (chi - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        expected = 2 * high * low / n + 1
        spread = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
        away = F.when(spread > 0, F.abs(runs - expected) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(F.lit(30.0))
        serial = F.when(c["w"]["own"] > 0, F.abs(c["w"]["cross"] / F.greatest(c["w"]["own"], F.lit(1e-9))) * F.sqrt(n)).otherwise(F.lit(30.0))
        ps = [_normal(-chi), 2 * _normal(-away), 2 * _normal(-serial)]
        half = reduce(lambda s, p: s - F.ln(F.least(F.greatest(p, F.lit(1e-100)), F.lit(1.0))), ps, F.lit(0.0))
        random = F.exp(-half) * (1 + half + half * half / 2) >= LEAST_RANDOM
        # Against text.
        two, three, up = c["e"]["two"], c["e"]["three"], c["e"]["high"]
        turn = 2 * up * (1 - up)
        few = (c["pairs"] - n * (n - 1) / 2 * two) / F.sqrt(n * (n - 1) / 2 * two * (1 - two) + n * (n - 1) * (n - 2) * (three - two * two))
        many = (runs - 1 - (n - 1) * turn) / F.sqrt((n - 1) * turn * (1 - turn) + 2 * (n - 2) * (turn / 2 - turn * turn))
        like = [_normal(few), _normal(-many), 2 * _normal(serial) - 1]
        values = [0.5 / F.sqrt(F.least(F.greatest(p, F.lit(LEAST_P)), F.lit(1.0))) for p in like]
        e = reduce(lambda s, v: s + v, values, F.pow(F.lit(2.0), F.least(c["bits"], F.lit(float(MOST_BITS))))) / (4 * len(ENCODINGS))
        weight = F.least(n, F.lit(float(LONGEST_WEIGHT)))
        evidence = F.when(random, F.floor(F.log2(e * weight) * 4) / 4)
        return F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), F.lit("random").alias("kind"), c["end"].alias("end"), weight.alias("weight"), evidence.alias("evidence"))

    return [("c", F.transform(candidates, letters)), *[("c", F.transform("c", f)) for f in (coded, summed, walked, judged)]]


def least_evidence(candidates: DataFrame) -> float | None:
    """The evidence from which on a candidate (weight, evidence) is a finding, by the weighted e-BH rule; None if nothing is.

    With m candidates of weights that average 1, the k with the greatest e-values are found, for the largest k of which all have a weighted e-value of m / (FALSE_DISCOVERIES k) or more.
    One row for each quarter of a bit comes together, whatever the number of candidates.
    """
    bins = candidates.groupBy("evidence").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weights"))
    everything, falling = Window.partitionBy(), Window.orderBy(F.col("evidence").desc_nulls_last())
    bins = bins.withColumn("total", F.sum("weights").over(everything)).withColumn("above", F.sum("n").over(falling))
    return bins.where(F.col("evidence") >= F.log2(F.col("total") / (FALSE_DISCOVERIES * F.col("above")))).agg(F.min("evidence")).first()[0]


def scan_secrets(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id) of docs (doc_id, text, ...) and base [(start, rank, kind, end)], spans (base and found random runs, by start and kind).

    Null and empty texts have no spans. Every candidate of every text is counted for the discovery rule. No text is shuffled: scanning is row by
    row, and its spans are stored once between the two passes.
    """
    keep = keep or ["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("kept"), *[_spans(text, kind, *how).alias(kind) for kind, how in BASE.items()], _spans(text, "random", CANDIDATE, 0, 1).alias("c"))
    slim = lambda x: F.struct(*[x[k].alias(k) for k in ("start", "rank", "kind", "end")])
    rows = rows.select("kept", F.transform(F.sort_array(F.concat(*BASE)), slim).alias("base"), "c")
    for name, step in _tested(F.col("c")):
        rows = rows.withColumn(name, step)
    rows = stored(rows, "secrets")
    least = least_evidence(rows.select(F.explode("c").alias("c")).select("c.weight", "c.evidence"))
    more = F.slice("base", 1, 0) if least is None else F.transform(F.filter("c", lambda x: x["evidence"] >= least), slim)
    return rows.select("kept.*", "base", F.sort_array(F.concat("base", more)).alias("spans"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
