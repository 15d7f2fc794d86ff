"""Secret scans: fixed patterns, and a battery of randomness tests over everything else.

Runs of letters, digits and `+/_-` are given the smallest alphabet that holds them (decimal digits, hex, base 32,
36, 62 or 64). Three tests ask whether a run could be random in that alphabet: chi-squared uniformity of its
symbols, the number of runs above and below the alphabet's middle, and the serial correlation of
neighbours; Fisher's method combines their p-values. Short words pass such tests for lack of symbols, so
that alone says little. How random text looks is learned from the corpus: runs of plain words give the mean and
spread of the logarithm of the evidence against randomness per symbol, which in text stays the same and in
random symbols falls with the length. Each candidate's p-value under that law so depends on its length; it goes through Benjamini-Hochberg over all candidates of the corpus. A run is
reported if randomness is not refused and text is.

All steps are column functions; positions are code points."""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.llm.tables import Staged, documents

KINDS = ("assign", "access", "hex", "random")
# Letters of the words stand in either case, in ASCII alone.
_WORDS = ("password", "passwd", "secret", "token")
_either = lambda word: "".join(f"[{c.upper()}{c}]" for c in word)
ASSIGN = ("(" + "|".join([*map(_either, _WORDS), _either("api") + "_?" + _either("key")])
          + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
LEAST_VALUE = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
# Runs that the battery looks at: shorter ones have too few symbols to tell.
LEAST_RUN = 20
RUN = "[A-Za-z0-9+/_-]{%d,}" % LEAST_RUN
# Symbols that are tested at a time; a pair across two blocks takes no part in the correlation.
BLOCK = 1024

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
# Alphabets in the order in which they are tried, each with the pattern of its runs.
ALPHABETS = (
    ("decimal", _DIGITS, "[0-9]+"),
    ("hex", _DIGITS + "abcdef", "[0-9a-f]+"),
    ("hex-upper", _DIGITS + "ABCDEF", "[0-9A-F]+"),
    ("base32", _UPPER + "234567", "[A-Z2-7]+"),
    ("base36", _DIGITS + _LOWER, "[0-9a-z]+"),
    ("base36-upper", _DIGITS + _UPPER, "[0-9A-Z]+"),
    ("base62", _UPPER + _LOWER + _DIGITS, "[A-Za-z0-9]+"),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", "[A-Za-z0-9+/]+"),
    ("base64-url", _UPPER + _LOWER + _DIGITS + "-_", "[A-Za-z0-9_-]+"),
    ("mixed", _UPPER + _LOWER + _DIGITS + "+/-_", "[A-Za-z0-9+/_-]+"),
)
# What a run of plain words, joined by hyphens, strokes or underlines, does not have.
NOT_PLAIN = "[0-9+]|[a-z][A-Z]|[A-Z]{2}[a-z]"
# Identifiers and card numbers are decimal; a secret has other symbols too.
REPORTED = tuple(name for name, _, _ in ALPHABETS if name != "decimal")

# Randomness is refused below this p-value of the battery.
REFUSED = 0.001
# Expected share of text among what is reported.
FALSE_DISCOVERIES = 0.01
# The law of text before any was seen: mean and spread, and the runs that this counts for.
PRIOR_MEAN, PRIOR_SPREAD, PRIOR_RUNS = -0.9, 0.75, 30.0
# Steps of -log10 p at which the discovery rule is tried; p-values below the last count as it.
STEP, STEPS = 0.05, 600


@dataclass(frozen=True)
class TextLaw:
    """ln((evidence + 1) / symbols) of a text is normal with this mean and spread."""
    mean: float
    spread: float
    # the smallest -log10 p that is a discovery
    threshold: float


# --- positions -----------------------------------------------------------------------------

def running_sums(values: Column) -> Column:
    """Sums of an array's entries up to each place, by doubling the reach: n log n steps, no copy per entry."""
    def step(sums, k):
        reach = F.call_function("shiftleft", F.lit(1), k)
        moved = F.concat(F.array_repeat(F.lit(0).cast("long"), F.least(reach, F.size(sums))),
                         F.slice(sums, F.lit(1), F.greatest(F.size(sums) - reach, F.lit(0))))
        return F.zip_with(sums, moved, lambda a, b: a + b)

    rounds = F.ceil(F.log2(F.size(values).cast("double"))).cast("int")
    return F.when(F.size(values) < 2, values).otherwise(
        F.aggregate(F.sequence(F.lit(0), F.greatest(rounds, F.lit(1)) - 1), values, step))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, m: (F.length(gap) + F.length(m)).cast("long"))
    spans = F.zip_with(found, running_sums(lengths), lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("found")))
    # most texts have no match: they need no splitting
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:long,end:long,found:string>>"))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the fixed patterns: failing matches are passed over, but nothing begins within them."""
    value = lambda m: F.regexp_extract(m["found"], ASSIGN, 2)
    bare = lambda spans: F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    return {"assign": bare(F.filter(matches(text, ASSIGN), lambda m: F.length(value(m)) >= LEAST_VALUE)),
            "access": bare(matches(text, ACCESS)), "hex": bare(matches(text, HEX))}


# --- the battery ---------------------------------------------------------------------------

def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal: continued fraction beyond 2.5, series of odd powers within."""
    def within(x):
        total = F.lit(1.0)
        for k in range(24, 0, -1):
            total = 1 + total * x * x / F.lit(2.0 * k + 1)
        return F.lit(0.5) - total * x * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)

    def beyond(x):
        fraction = x + F.lit(0.0)
        for k in range(28, 0, -1):
            fraction = x + F.lit(float(k)) / fraction
        return F.exp(-x * x / 2) / math.sqrt(2 * math.pi) / fraction

    # each argument is evaluated once
    return F.transform(F.array(z), lambda x: F.when(x > 2.5, beyond(F.greatest(x, F.lit(1.0)))).when(
        x < -2.5, 1 - beyond(F.greatest(-x, F.lit(1.0)))).otherwise(within(F.greatest(F.least(x, F.lit(2.5)), F.lit(-2.5)))))[0]


def _blocks(run: Column) -> Column:
    return F.regexp_extract_all(run, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))


def _squares(block: Column, alphabet: str) -> list[Column]:
    """How often each symbol stands in a block."""
    return [F.length(block) - F.length(F.replace(block, F.lit(c), F.lit(""))) for c in alphabet]


def uniformity(run: Column, alphabet: str) -> Column:
    """Chi-squared of the symbol counts against equal ones, as a normal deviate (Wilson and Hilferty)."""
    k, n = len(alphabet), F.length(run)
    total = sum((c * c).cast("double") for c in _squares(run, alphabet))
    chi, freedom = total * k / n - n, float(k - 1)
    return (F.pow(F.greatest(chi, F.lit(0.0)) / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom))


def runs(run: Column, alphabet: str) -> Column:
    """Runs of symbols below and above the alphabet's middle, against those expected, as a normal deviate."""
    half = len(alphabet) // 2
    sides = F.translate(run, alphabet, "0" * half + "1" * (len(alphabet) - half))
    n = F.length(run).cast("double")
    changes = lambda two: (n - F.length(F.replace(sides, F.lit(two), F.lit("")))) / 2
    low = n - F.length(F.replace(sides, F.lit("0"), F.lit("")))
    share = F.lit(half / len(alphabet))
    # each neighbouring pair differs with probability 2 p q
    p = 2 * share * (1 - share)
    variance = (n - 1) * p * (1 - p) + 2 * (n - 2) * (share * (1 - share) - p * p)
    return F.transform(F.array(changes("01") + changes("10")), lambda c: (c - (n - 1) * p) / F.sqrt(F.greatest(variance, F.lit(1e-9))))[0]


def serial_correlation(run: Column, alphabet: str) -> Column:
    """Products of neighbouring symbols' places from the alphabet's middle, as a normal deviate."""
    k = len(alphabet)
    middle, variance = (k - 1) / 2, (k * k - 1) / 12
    def of_block(block):
        place = F.transform(F.filter(F.split(block, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1 - F.lit(middle))
        return F.transform(F.array(place), lambda x: F.aggregate(
            F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: a * b),
            F.lit(0.0), lambda s, v: s + v))[0]

    blocks = _blocks(run)
    pairs = F.length(run) - F.ceil(F.length(run) / BLOCK)
    total = F.aggregate(blocks, F.lit(0.0), lambda s, b: s + of_block(b))
    return total / (variance * F.sqrt(F.greatest(pairs, F.lit(1)).cast("double")))


def _exclusive(run: Column, choose) -> Column:
    """`choose` of the first alphabet that holds the run."""
    out = None
    for name, alphabet, pattern in ALPHABETS:
        value = choose(name, alphabet)
        holds = run.rlike(f"^{pattern}$")
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return out


def battery(run: Column) -> Column:
    """(alphabet, evidence): minus the natural logarithm of the combined p-value that the run is random in its alphabet.

    Fisher's statistic of three tests has six degrees of freedom, whose tail is exp(-x/2) (1 + x/2 + x^2/8)."""
    def tested(name, alphabet):
        p = [upper_tail(uniformity(run, alphabet)), 2 * upper_tail(F.abs(runs(run, alphabet))), 2 * upper_tail(F.abs(serial_correlation(run, alphabet)))]
        half = -sum(F.log(F.greatest(x, F.lit(1e-290))) for x in p)  # x / 2
        evidence = F.transform(F.array(half), lambda h: h - F.log(1 + h + h * h / 2))[0]
        return F.struct(F.lit(name).alias("alphabet"), evidence.alias("evidence"))

    return _exclusive(run, tested)


# --- the law of text, and discoveries --------------------------------------------------------

def _rate(candidate: Column) -> Column:
    """Evidence against randomness per symbol; of random symbols it is about 1 over all."""
    return F.log((candidate["evidence"] + 1) / candidate["size"])


def _minus_log10(candidate: Column, mean: float, spread: float) -> Column:
    """-log10 of the chance that a text of this length looks as random as the candidate."""
    return -F.log10(F.greatest(upper_tail((F.lit(mean) - _rate(candidate)) / F.lit(spread)), F.lit(1e-30)))


def text_law(candidates: DataFrame, false_discoveries: float = FALSE_DISCOVERIES) -> TextLaw:
    """The law of text and the discovery threshold from all candidates (size, evidence, plain) of a corpus.

    Of plain runs only sums are gathered, of all runs a histogram of `STEPS` bins. At each step t the rule
    reads: 10^-t times the number of candidates, over those with p <= 10^-t, is at most the allowed share; the
    smallest such t counts (Benjamini-Hochberg on a grid)."""
    one = F.struct("size", "evidence")
    sums = candidates.filter("plain").select(_rate(one).alias("r")).agg(
        F.sum("r").alias("r"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.count("*").alias("many")).first()
    many, total = sums["many"], sums["r"] or 0.0
    mean = (PRIOR_MEAN * PRIOR_RUNS + total) / (PRIOR_RUNS + many)
    apart = (sums["rr"] or 0.0) - 2 * mean * total + mean ** 2 * many
    spread = math.sqrt((PRIOR_SPREAD ** 2 * PRIOR_RUNS + max(apart, 0.0)) / (PRIOR_RUNS + many))
    step = F.least(F.floor(_minus_log10(one, mean, spread) / STEP), F.lit(STEPS)).cast("int")
    counts = {r["step"]: r["n"] for r in candidates.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    total, above, threshold = sum(counts.values()), 0, math.inf
    for k in range(STEPS, -1, -1):
        above += counts.get(k, 0)
        if above and total * 10 ** (-k * STEP) <= false_discoveries * above:
            threshold = k * STEP
    return TextLaw(mean, spread, threshold)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, and the candidates of each text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    runs_ = F.transform(matches(F.col("text"), RUN), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), F.length(m["found"]).alias("size"),
        (~m["found"].rlike(NOT_PLAIN)).alias("plain"), battery(m["found"]).alias("tested")))
    candidates = F.transform(runs_, lambda m: F.struct(m["start"], m["end"], m["size"], m["plain"],
                                                       m["tested"]["alphabet"].alias("alphabet"), m["tested"]["evidence"].alias("evidence")))
    return rows.select("doc_id", *[c.alias(k) for k, c in base_spans(F.col("text")).items()], candidates.alias("candidates"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, false_discoveries: float = FALSE_DISCOVERIES) -> DataFrame:
    """`docs` (doc_id, text) to doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Null texts are empty; texts without spans have the empty string, and its hash. A random run that
    overlaps a span of the patterns is not reported beside it. Rows that repeat an id or a text are answered
    each and count each in the corpus-wide law; a null id stays null. Spans with equal starts stand in the
    order of `KINDS`. Other columns are not looked at. An empty table gives no rows."""
    tables = Staged(docs.sparkSession)
    found = tables.write(scanned(docs), "secret-scan")
    law = text_law(found.select(F.inline("candidates")).select("size", "evidence", "plain"), false_discoveries)
    numbered = lambda kind: F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))
    base = F.concat(*[numbered(k) for k in KINDS[:3]])
    def reported(c):
        return ((c["evidence"] <= -math.log(REFUSED)) & ~c["plain"] & c["alphabet"].isin(*REPORTED)
                & (_minus_log10(c, law.mean, law.spread) >= F.lit(law.threshold)))
    apart = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    rows = found.withColumn("base", base)
    random = F.transform(F.filter("candidates", lambda c: reported(c) & apart(c)),
                         lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    rows = rows.withColumn("random", random)
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                       F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       _joined(F.concat("base", "random")).alias("spans"))


def op12_secret_scan(spark, sf_dir):
    return secret_spans(documents(spark, sf_dir))
