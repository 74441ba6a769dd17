"""Secret scans in DataFrame functions only: fixed patterns, and a battery of randomness tests.

Pattern spans are the leftmost non-overlapping matches of three kinds.  The
battery looks at long tokens of encoded data: it infers the token's alphabet and
tests whether its symbols look drawn at random (uniform by chi-squared, right
number of runs about the middle, no serial correlation).  A false-discovery
control over all tokens of the table decides which are *not* random; what stays
is reported as kind ``random``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import scratch, stored

# Kinds in the order in which equal starts are listed, with pattern, group that is measured and least length.
# Runs of hex digits and of token characters are maximal, so their least length can stand in the pattern.
_ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = [("assign", _ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16)]
# A text with a span of the kind matches these; most texts match none and are passed over.
_MAY = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_TOKENS = "array<struct<start:int,kind:int,end:int,token:string>>"
# Alphabets by symbol order.
_HEX_SET, _BASE32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
# The symbols of standard and URL-safe encodings. A run of either is a token; "=" belongs to it only as padding, where nothing follows.
_SYMBOLS = ["A-Za-z0-9+/", "A-Za-z0-9_-"]
_PADDING = "(?:=+(?![A-Za-z0-9+/_=-]))?"


def _pieces(text: str, pattern: str, group: int) -> Column:
    """What lies between a pattern's matches, the matches, and their groups: lengths add up to positions."""
    t, p = F.col(text), F.lit(pattern)
    return F.arrays_zip(F.split(t, pattern, -1).alias("gap"), F.regexp_extract_all(t, p, F.lit(0)).alias("all"), F.regexp_extract_all(t, p, F.lit(group)).alias("part"))


def _spans(pieces: str, kind: int, least: int, tokens: bool = False) -> Column:
    """Spans (code points, end exclusive) of the matches whose group has ``least`` characters.

    An appended-to array is copied, so pieces are taken in runs of about the square
    root of their number: a text with n matches costs n times that root in copies,
    not n squared.
    """
    size = F.size(pieces)
    run = F.ceil(F.sqrt(size.cast("double"))).cast("int")
    none = F.array().cast(_TOKENS if tokens else _SPAN)

    def add(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["gap"])
        end = start + F.coalesce(F.length(m["all"]), F.lit(0))
        fields = [start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), *[m["all"].alias("token")] * tokens]
        return F.struct(end.alias("at"), F.when(F.length(m["part"]) >= least, F.concat(acc["out"], F.array(F.struct(*fields)))).otherwise(acc["out"]).alias("out"))

    def add_run(acc: Column, i: Column) -> Column:
        own = F.aggregate(F.slice(pieces, i * run + 1, run), F.struct(acc["at"].alias("at"), none.alias("out")), add)
        return F.struct(own["at"].alias("at"), F.concat(acc["out"], F.array(own["out"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_TOKENS if tokens else _SPAN}>").alias("out"))
    spans = F.aggregate(F.sequence(F.lit(0), run - 1), start, add_run, lambda acc: F.flatten(acc["out"]))
    return F.when(size > 1, spans).otherwise(none)


def _normal_tail(z: Column) -> Column:
    """P(|Z| > z) for z >= 0, by the rational approximation of erfc (error below 2e-7)."""
    x = z / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-300))


def battery(tokens: DataFrame) -> DataFrame:
    """``tokens(.., token)`` with ``n``, the token's symbols, and ``p``, the tests' joint p-value under randomness.

    Tokens that no encoding fits are left out: hexadecimal of one case, base32, or
    base64 in either alphabet.  Encodings of more than 16 symbols must show upper
    case and digits, and base64 lower case as well; plain words do not.
    """
    s = F.col("s")
    hexa = (s.rlike("^[0-9a-f]+$") | s.rlike("^[0-9A-F]+$")) & s.rlike("[0-9]") & s.rlike("[A-Fa-f]")
    base32 = s.rlike("^[A-Z2-7]+$") & s.rlike("[2-7]") & s.rlike("[A-Z]")
    base64 = s.rlike("[a-z]") & s.rlike("[A-Z]") & s.rlike("[0-9]") & s.rlike("^([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)$")
    base = tokens.withColumn("s", F.rtrim("token", F.lit("=")))
    base = base.withColumn("alphabet", F.when(hexa, F.lit(_HEX_SET)).when(base32, F.lit(_BASE32)).when(base64, F.lit(_BASE64))).filter("alphabet is not null")
    base = base.withColumn("s", F.when(F.col("alphabet") == _HEX_SET, F.lower("s")).otherwise(F.translate("s", "-_", "+/")))
    base = base.withColumns({"n": F.length("s").cast("double"), "k": F.length("alphabet").cast("double")})
    n, k = F.col("n"), F.col("k")
    squares = F.aggregate(F.split("alphabet", ""), F.lit(0.0), lambda a, c: a + F.pow((n - F.length(F.replace(s, c, F.lit("")))), F.lit(2.0)))
    base = base.withColumns({"chi": squares * k / n - n, "v": F.transform(F.split("s", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double"))})
    bits = F.array_join(F.transform("v", lambda v: F.when(v > k / 2, F.lit("1")).otherwise(F.lit("0"))), "")
    base = base.withColumns({"bits": bits, "mean_v": F.aggregate("v", F.lit(0.0), lambda a, v: a + v) / n})
    base = base.withColumns({"off": F.transform("v", lambda v: v - F.col("mean_v")), "n1": F.length(F.replace("bits", F.lit("0"), F.lit(""))).cast("double")})
    energy = F.aggregate("off", F.lit(0.0), lambda a, v: a + v * v)
    pairs = F.zip_with(F.slice("off", F.lit(1), F.size("off") - 1), F.slice("off", F.lit(2), F.size("off") - 1), lambda a, b: a * b)
    serial = F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v) / F.greatest(energy, F.lit(1e-9))
    base = base.withColumns({"serial": serial, "runs": F.regexp_count("bits", F.lit("0+|1+")).cast("double"), "mean_r": 2 * F.col("n1") * (n - F.col("n1")) / n + 1})
    df, r = k - 1, F.col("mean_r")
    base = base.withColumns(
        {
            "z_chi": (F.pow(F.greatest("chi", F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)),
            "z_runs": F.abs(F.col("runs") - r) / F.sqrt(F.greatest((r - 1) * (r - 2) / (n - 1), F.lit(1e-9))),
            "z_serial": F.abs(F.col("serial") + 1 / n) * F.sqrt(n),
        }
    )
    p_chi = F.when(F.col("z_chi") > 0, _normal_tail(F.col("z_chi")) / 2).otherwise(1 - _normal_tail(-F.col("z_chi")) / 2)
    base = base.withColumn("half", -(F.ln(p_chi) + F.ln(_normal_tail(F.col("z_runs"))) + F.ln(_normal_tail(F.col("z_serial")))))
    half = F.col("half")  # Fisher: twice this is chi-squared with six degrees of freedom
    return base.select(*tokens.columns, "n", F.greatest(F.exp(-half) * (1 + half + half * half / 2), F.lit(1e-300)).alias("p"))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, rate: float = 0.1) -> DataFrame:
    """``(id_col, base, random)``: spans ``struct<start, kind, end>`` in code points, end exclusive.

    ``base`` has the pattern spans by start, then kind (0 assign, 1 access, 2 hex).
    ``random`` has tokens of ``least`` symbols or more that no base span touches and
    whose battery is not rejected.  The runs of the standard and of the URL-safe
    symbols are tokens each, so a value is tested apart from the name before its
    ``=`` and from a path around it; of those told, one inside another is left out.
    Rejection is weighted step-up control at
    ``rate`` over all tokens of the table: a p-value is divided by the token's
    length relative to the mean, because tests of longer tokens have more power.
    The step-up works on counts of p-values in bins of a tenth of a decade, a table
    of bounded size.

    Null texts count as empty and have no spans.  Repeated rows are scanned each
    on their own; null ids are carried along; other columns are not read; an empty
    table stays empty.  Long texts with very many matches cost little more than in
    proportion.
    """
    spark = df.sparkSession
    with scratch(spark) as keep:
        text = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
        looks = [(kind, pattern, group, i, size, _MAY[kind], False) for i, (kind, pattern, group, size) in enumerate(KINDS)]
        looks += [(f"tok{j}", f"(?<![{c}])[{c}]{{{least},}}{_PADDING}", 0, 3, least, f"[{c}]{{{least}}}", True) for j, c in enumerate(_SYMBOLS)]
        # most texts match nothing and are not taken apart
        pieces = text.select("_id", *[F.when(F.col("_t").rlike(may), _pieces("_t", pattern, group)).alias(f"_p_{kind}") for kind, pattern, group, _, _, may, _ in looks])
        spans = {kind: F.coalesce(_spans(f"_p_{kind}", i, size, tokens), F.array().cast(_TOKENS if tokens else _SPAN)) for kind, _, _, i, size, _, tokens in looks}
        base = F.array_sort(F.concat(*[spans[kind] for kind, *_ in KINDS]))
        tokens = F.concat(*[spans[f"tok{j}"] for j in range(len(_SYMBOLS))])
        # stored, so that row numbers stay and no span is looked for twice
        found = keep(stored(pieces.select("_id", base.alias("base"), tokens.alias("_tok")).withColumn("_row", F.monotonically_increasing_id())))
        tested = stored(battery(_free_tokens(found)).filter(F.col("n") >= least).drop("token"))
        m, mean = tested.agg(F.count("*"), F.avg("n")).first()
        limit = _step_up(tested, m, mean, rate) if m else 0.0
        kept = tested.filter(_bin(F.col("p") * F.lit(mean or 1.0) / F.col("n")) < limit)
        before = Window.partitionBy("_row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
        kept = kept.withColumn("_reach", F.max("end").over(before)).filter("_reach is null or end > _reach")
        kept = keep(stored(kept.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end"))).alias("random"))))
    return found.join(kept, "_row", "left").select(F.col("_id").alias(id_col), "base", F.coalesce("random", F.array().cast(_SPAN)).alias("random"))


def _free_tokens(found: DataFrame) -> DataFrame:
    """``(_row, start, end, token)``: tokens that no base span touches, each once (a run of letters and digits is found twice).

    A span begun before a token's end touches it if it reaches beyond the token's
    start, so the farthest end of the spans begun so far decides: one sort a text.
    """
    marks = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("is_base"), s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("string").alias("token"))),
        F.transform("_tok", lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("is_base"), s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token"))),
    )
    rows = found.filter(F.size("_tok") > 0).select("_row", F.inline(marks))
    order = Window.partitionBy("_row").orderBy("at", "is_base", "start")
    reach = F.max(F.when(F.col("is_base") == 1, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    twin = (F.lag("at").over(order) == F.col("at")) & (F.lag("is_base").over(order) == 0) & (F.lag("start").over(order) == F.col("start"))
    rows = rows.withColumns({"_reach": reach, "_twin": twin}).filter("is_base = 0 and not coalesce(_twin, false) and coalesce(_reach, 0) <= start")
    return rows.select("_row", "start", "end", "token")


def _bin(p: Column) -> Column:
    """Tenths of a decade below 1: larger is less probable."""
    return F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * 10)


def _step_up(tests: DataFrame, m: int, mean: float, rate: float) -> float:
    """The least bin that is rejected: the largest p-value bound not above ``rate`` times its rank over ``m``."""
    counts = tests.groupBy(_bin(F.col("p") * F.lit(mean) / F.col("n")).alias("b")).count().orderBy(F.desc("b")).collect()  # some 3000 bins at most
    rank, limit = 0, float("inf")
    for b, count in counts:
        rank += count
        if 10 ** (-b / 10) <= rate * rank / m:
            limit = float(b)
    return limit


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
