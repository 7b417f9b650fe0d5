"""Operator 2, secret scans: fixed patterns and a battery of randomness tests.

Patterns find assignments, access keys and hex strings. The battery judges every run of 16
or more key characters that holds a letter, against the hypothesis that it is ordinary:
words, identifiers, paths, numbers. Its encoding is inferred, as the smallest alphabet that
holds it, and gives the ordinary figures that three tests compare it with:

* chi-squared of uniform use of the alphabet: ordinary text repeats letters, so its
  statistic is large; a small one is evidence of a key;
* runs of one character class (digits, capitals, small letters): ordinary strings change
  seldom. A capital before a small letter begins a word and signs part words, so neither
  is a change;
* lag-one serial correlation of the letters' being vowels: in words vowels and consonants
  alternate, in keys they don't.

The z scores, each bounded, so that no test decides alone, are summed (Stouffer) and give a
p-value by a bound of the normal tail (Mills'), so never too small. The p-values of all runs of a
document pass the Benjamini-Hochberg rule with weights in proportion to length: the
expected share of false finds among the added spans of a document is at most FDR, as far
as ordinary strings are as the figures say. A document is a family of its own, so its
result doesn't depend on other documents and the scan is a map. Everything is built-in
expressions; work and memory are linear in the text but for sorting and running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bind, powers, running_sums

# The base patterns. Letters of the first stand in either case, ASCII alone.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
MIN_ASSIGN, MIN_ACCESS = 8, 16

CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
#: (name, characters, size): alphabets from small to large.
ALPHABETS = (("decimal", "0-9", 10), ("hex", "0-9a-f", 16), ("HEX", "0-9A-F", 16), ("lower", "a-z", 26), ("UPPER", "A-Z", 26), ("base32", "A-Z2-7", 32), ("base36", "0-9a-z", 36), ("BASE36", "0-9A-Z", 36), ("base52", "A-Za-z", 52), ("base62", "0-9A-Za-z", 62), ("base64", "0-9A-Za-z+/", 64), ("base64url", "0-9A-Za-z_-", 64), ("mixed", "0-9A-Za-z+/_-", 66))
#: Of ordinary strings by alphabet size: chances that two and that three characters are equal,
#: and how often the class changes between neighbours (none: one class, no test).
ORDINARY = {16: (0.090, 0.0110, 0.12), 26: (0.065, 0.0056, None), 32: (0.055, 0.0040, 0.12), 36: (0.055, 0.0040, 0.12), 52: (0.056, 0.0042, 0.22), 62: (0.054, 0.0039, 0.30), 64: (0.054, 0.0039, 0.30), 66: (0.054, 0.0039, 0.30)}
#: How often vowels and consonants alternate between neighbouring letters of words.
ALTERNATION = 0.58
#: The serial test needs so many pairs of letters; of the sixteen hex characters it has no say.
MIN_PAIRS = 6
FDR = 0.01
#: Bounds of a test's z score.
LEAST_Z, MOST_Z = -6.0, 4.0

_VOWEL, _CONSONANT = "[aeiouAEIOU]", "[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]"
CHANGE = "(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
NEIGHBOURS = "[A-Za-z0-9](?=[A-Za-z0-9])"
LETTERS = "[A-Za-z](?=[A-Za-z])"
ALTERNATE = f"{_VOWEL}(?={_CONSONANT})|{_CONSONANT}(?={_VOWEL})"
_SPANS = "cast(array() as array<struct<start:int,end:int,size:int,value:string>>)"


def _found(text: str, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, size, value>> of all matches, leftmost first, in code points.

    ``value`` is the group and ``size`` its length. The text between matches gives the places.
    """

    def placed(matches: Column) -> Column:
        values = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)) if group else matches
        lengths = F.zip_with(F.split(F.col(text), pattern, -1), matches, lambda g, m: F.array(F.length(g), F.coalesce(F.length(m), F.lit(0))))
        # Ends of gap, match, gap, match, ...
        return bind(running_sums(F.flatten(lengths)), lambda s: F.transform(values, lambda v, i: F.struct(F.get(s, 2 * i).alias("start"), F.get(s, 2 * i + 1).alias("end"), F.length(v).alias("size"), v.alias("value"))))

    return bind(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(F.expr(_SPANS)))


def _digest(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(x) for x in ("assign", "access", "hex", "random")])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _covered(spans: str, x: Column) -> Column:
    """Whether a span of an ordered, non-overlapping array covers ``x``: a binary search."""
    size = F.size(spans)

    def step(p: Column, d: Column) -> Column:
        return F.when((p + d <= size) & (F.get(F.col(spans), p + d - 1)["start"] <= x["start"]), p + d).otherwise(p)

    last = F.aggregate(F.reverse(powers(size)), F.lit(0), step)  # spans that start at x or before
    return F.when(size == 0, F.lit(False)).otherwise(F.coalesce(bind(last, lambda p: F.get(F.col(spans), p - 1)["end"] >= x["end"]), F.lit(False)))


def battery(run: str) -> str:
    """SQL of struct<n, k, equal, z_uniform, z_runs, z_serial, p> of a run of key characters.

    ``equal``: pairs of equal characters; chi-squared of uniform use is k (2 equal + n) / n - n.
    A z score is null where its test has no say. No array as long as the run is made.
    """

    def bind(name: str, value: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    def case(at: int) -> str:
        return "case k " + " ".join(f"when {k} then {'null' if v[at] is None else f'{v[at]}D'}" for k, v in ORDINARY.items()) + " end"

    k = "case " + " ".join(f"when {run} rlike '^[{chars}]+$' then {size}" for _, chars, size in ALPHABETS) + " else 66 end"
    signs = "".join(chr(c) for c in range(33, 127) if chr(c).isalnum()) + "+/_-"
    equal = f"aggregate(split('{signs}', ''), 0D, (a, c) -> a + transform(array(n - length(replace({run}, c, ''))), o -> o * (o - 1D) / 2)[0])"
    pairs = "(n * (n - 1D) / 2)"
    spread = f"sqrt({pairs} * (u - u * u) + 2 * {pairs} * (n - 2) * (w - u * u))"

    def bounded(z: str) -> str:
        return f"greatest({LEAST_Z}D, least({MOST_Z}D, {z}))"

    uniform = bounded(f"({pairs} * u - e) / {spread}")
    runs = f"if(r is null or t = 0, null, {bounded('(h - t * r) / sqrt(t * r * (1 - r))')})"
    serial = f"if(k = 16 or l < {MIN_PAIRS}, null, {bounded(f'(l * {ALTERNATION}D - v) / sqrt(l * {ALTERNATION * (1 - ALTERNATION)}D)')})"
    made = "named_struct('n', n, 'k', k, 'equal', e, 'z_uniform', z.a, 'z_runs', z.b, 'z_serial', z.c, 'p', if(s <= 0, 1D, exp(-s * s / 2) / greatest(2D, s * sqrt(2 * pi()))))"
    total = "(z.a + coalesce(z.b, 0D) + coalesce(z.c, 0D)) / sqrt(1D + if(z.b is null, 0, 1) + if(z.c is null, 0, 1))"
    body = bind("z", f"named_struct('a', {uniform}, 'b', {runs}, 'c', {serial})", bind("s", total, made))
    for name, value in (("v", f"regexp_count({run}, '{ALTERNATE}')"), ("l", f"regexp_count({run}, '{LETTERS}')"), ("h", f"regexp_count({run}, '{CHANGE}')"), ("t", f"regexp_count({run}, '{NEIGHBOURS}')"), ("e", equal), ("r", case(2)), ("w", case(1)), ("u", case(0)), ("k", k), ("n", f"length({run})")):
        body = bind(name, value, body)
    return body


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Spans are those of whole matches, in code points, end exclusive. ``spans`` holds the
    base spans and, as kind ``random``, the battery's finds among runs that no base span
    covers. Null and empty texts have none. Texts and runs may be of any length. Repeated
    rows and null ids give a row each; other columns aren't read.
    """
    text = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    base = text.withColumns({"_assign": F.filter(_found("_text", ASSIGN, 2), lambda s: s["size"] >= MIN_ASSIGN), "_access": F.filter(_found("_text", ACCESS), lambda s: s["size"] >= MIN_ACCESS), "_hex": _found("_text", HEX), "_at": _found("_text", CANDIDATE)})
    base = base.withColumn("_runs", F.filter("_at", lambda x: ~(_covered("_assign", x) | _covered("_access", x) | _covered("_hex", x))))
    # Runs without a letter are numbers: they count as runs, and no test finds them.
    judged = f"transform(filter(_runs, x -> x.value rlike '[A-Za-z]'), x -> named_struct('start', x.start, 'end', x.end, 'b', {battery('x.value')}))"
    base = base.withColumn("_judged", F.expr(judged))
    # Weighted Benjamini-Hochberg: p over its weight, in order, against its rank; the mean weight is one.
    length = F.expr("aggregate(_runs, 0L, (a, r) -> a + r.size) / cast(greatest(1, size(_runs)) as double)")
    ranked = F.expr("array_sort(transform(_judged, x -> named_struct('q', x.b.p * _mean / x.b.n, 'start', x.start, 'end', x.end)))")
    base = base.withColumn("_mean", length).withColumn("_ranked", ranked)
    last = f"aggregate(sequence(1, greatest(1, size(_ranked))), 0, (a, i) -> if(get(_ranked, i - 1).q <= i * {FDR}D / size(_runs), i, a))"
    added = F.expr(f"if(size(_ranked) = 0, cast(array() as array<struct<start:int,kind:int,end:int>>), transform(slice(_ranked, 1, {last}), x -> named_struct('start', x.start, 'kind', 3, 'end', x.end)))")
    base = base.withColumn("_known", F.concat(_spans(F.col("_assign"), 0), _spans(F.col("_access"), 1), _spans(F.col("_hex"), 2))).withColumn("_added", added)
    return base.select(
        F.col("_id").alias(id_col),
        F.size("_assign").cast("long").alias("n_assign"),
        F.size("_access").cast("long").alias("n_access"),
        F.size("_hex").cast("long").alias("n_hex"),
        F.sha2(_digest(F.col("_known")).cast("binary"), 256).alias("base_sha256"),
        _digest(F.concat("_known", "_added")).alias("spans"),
        F.size("_added").cast("long").alias("n_random"),
    )
