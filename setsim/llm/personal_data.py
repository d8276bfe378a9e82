"""Personal data and secrets by generated candidates and boosted trees, in SQL functions only.

Four plain patterns give the base spans. Wider generators propose further spans, such as a
card number that a plain match swallowed, a national phone number, a spelt-out address or a
long run of letters and digits that may be a secret. Boosted trees score each proposal by
its format and what stands beside it; thresholds are calibrated per kind on held-out
documents. Where accepted proposals overlap, the best one of each cluster stays, and none
may touch a base span.

The trees are fitted to the corpus itself: of the plain patterns' matches those that pass
their check are examples and those that fail it counterexamples, and a proposed secret is an
example if a word such as password stands before it. The checks and those words are no
features, so trees learn format and context. At most MAX_EXAMPLES candidates are taken, by
hash; generated examples stand in for forms that a corpus may lack. A proposed card or
phone must pass its check whatever its score.

Patterns use possessive repeats, and look behind where a scan could start over in the same
run of characters, so that very long texts take linear time and no deep recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import boosting
from .shared import KEY, ROW, discard, keyed, row_key, sampled, written

#: Kinds of base spans, and the kind that only the method adds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
# The base patterns, spelt so that they match exactly what the plain ones match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators of further candidates.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.])(?:[0-9]{4}[ ./-]?){3}[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{3,4}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9+/_=.@-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![A-Za-z0-9@])",
}
CUES = {
    "email": r"(?i)(?:mail|contact|write|address)[^\n]*$",
    "ip": r"(?i)(?:\bip|host|server|addr)[^\n]*$",
    "card": r"(?i)(?:card|visa|master|credit|pay)[^\n]*$",
    "phone": r"(?i)(?:phone|call|tel|fax|mobile|cell|\+)[^\n]*$",
}
#: Words before a run of letters and digits that name it a secret, and a sign of assignment.
SECRET_WORDS = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api.?key|access.?key|private.?key|credential|auth|bearer)[^\n]*$"
ASSIGNED = r"(?:=|:|->) ?[\"'`]?$"
DECOYS = r"(?i)(?:\b(?:isbn|order|invoice|version|id|no|ref|serial|date|release)\b)[^\n]*$"
FEATURES = ["f_kind", "f_seps", "f_length", "f_plus", "f_paren", "f_groups", "f_cue", "f_decoy", "f_first", "f_left", "f_right", "f_runs", "f_hex", "f_assigned"]
#: Most candidates of the corpus that the trees are fitted to.
MAX_EXAMPLES = 20_000
#: Share of accepted held-out examples that must be right.
PRECISION = 0.95


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the 12 to 19 digits of a match pass Luhn's check; false for any other number of them."""
    rev = F.reverse(digits_of(match))
    at = lambda i: F.substring(rev, i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), F.length(rev)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, at(i)).otherwise(twice(at(i))))
    return F.when(F.length(rev).between(12, 19), total % 10 == 0).otherwise(False)


def valid(kind: Column, match: Column) -> Column:
    """What a base match must also satisfy."""
    part = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(f"^{part}(?:\\.{part}){{3}}$"))
        .when(kind == "card", luhn(match))
        .otherwise(F.length(digits_of(match)).between(9, 15))
    )


def char_class(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"[ \n\t]"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"[\p{L}_]"), 3).otherwise(4)


def features() -> list[Column]:
    """The trees' inputs, of columns kind, match, before and after."""
    kind, match = F.col("kind"), F.col("match")
    by_kind = lambda values: F.coalesce(*(F.when(kind == k, v) for k, v in values.items()), F.lit(0))
    values = {
        "f_kind": by_kind({k: F.lit(n) for n, k in enumerate(ALL_KINDS)}),
        "f_seps": F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")),
        "f_length": F.length(match),
        "f_plus": match.startswith("+").cast("int"),
        "f_paren": F.instr(match, ")"),
        "f_groups": F.when(match.rlike(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), 2).when(match.rlike(r"^[0-9]{4}-[0-9]{2,3}-"), 1).otherwise(0),
        "f_cue": by_kind({k: F.col("before").rlike(c).cast("int") for k, c in CUES.items()}),
        "f_decoy": F.col("before").rlike(DECOYS).cast("int"),
        "f_first": F.ascii(match) - 32,
        "f_left": char_class(F.right("before", F.lit(1))),
        "f_right": char_class(F.left("after", F.lit(1))),
        "f_runs": F.length(F.regexp_replace(match, "[0-9]+|[A-Za-z]+", "x")),
        "f_hex": F.when(match.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 2).when(match.rlike("[a-z]") & match.rlike("[A-Z]"), 1).otherwise(0),
        "f_assigned": F.col("before").rlike(ASSIGNED).cast("int"),
    }
    return [boosting.clipped(v).alias(n) for n, v in values.items()]


def examples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Generated candidates of each kind with their labels: kind, match, before, after, label, fold."""
    pick = lambda salt, m: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(m))
    num = lambda salt, k: F.lpad(pick(salt, 10**k).cast("string"), k, "0")
    oneof = lambda salt, *xs: F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in xs)), (pick(salt, len(xs)) + 1).cast("int"))
    # Forms that examples take.
    name, host, dot = oneof(1, "anna.k", "jo_lee", "m.ruiz7", "sales"), oneof(2, "example", "mail-3", "corp"), oneof(3, " (dot) ", "[dot]", ".")
    body = F.concat(oneof(4, "4", "5", "37"), num(5, 14))
    check = lambda d: F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: luhn(F.concat(d, c.cast("string")))), 1).cast("string")
    group4 = lambda d, sep: F.concat_ws(sep, *(F.substring(d, k, 4) for k in (1, 5, 9)), F.substring(d, 13, 7))
    good_card = F.concat(body, check(body))
    hex4 = lambda s: F.lower(F.lpad(F.hex(pick(s, 65536)), 4, "0"))
    forms = {
        ("email", 1): F.concat(name, oneof(6, " (at) ", "[at]"), host, dot, oneof(7, "com", "org", "net")),
        ("email", 0): F.concat(oneof(1, "see", "meet", "list", "x"), oneof(6, " (at) ", "(at) "), oneof(2, "noon", "home", "3"), F.lit("."), oneof(7, "Then", "We", "5")),
        ("ip", 1): F.concat_ws(":", *(hex4(k) for k in range(10, 18))),
        ("ip", 0): F.concat_ws(":", *(num(k, 2) for k in range(10, 18))),
        ("card", 1): oneof(20, good_card, group4(good_card, " "), group4(good_card, "-")),
        ("card", 0): oneof(20, good_card, group4(good_card, "-"), F.concat(F.lit("2024"), num(22, 10))),  # told by what stands before
        ("phone", 1): F.concat(oneof(30, "+1 ", "+44 ", "", ""), oneof(31, F.concat(F.lit("("), num(32, 3), F.lit(") ")), F.concat(num(32, 3), F.lit("-"))), num(33, 3), oneof(34, "-", " "), num(35, 4)),
        ("secret", 1): oneof(50, F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40), F.substring(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), 3, 32), F.concat(F.lit("sk_"), F.substring(F.sha1(F.col("id").cast("string")), 1, 24))),
        ("secret", 0): oneof(50, F.concat(F.lit("section-"), num(51, 1), F.lit("-of-the-report")), F.concat(F.lit("home/user"), num(51, 2), F.lit("/documents/letters")), F.concat(F.lit("version_"), num(51, 2), F.lit("_released_today")), F.concat(F.lit("2024-"), num(51, 2), F.lit("-"), num(52, 2), F.lit("T"), num(53, 6), F.lit("Z"))),
        ("phone", 0): oneof(30, F.concat(F.lit("2024-"), num(31, 3), F.lit("-"), num(32, 3)), F.concat(num(31, 2), F.lit("."), num(32, 3), F.lit("."), num(33, 3)), F.concat(num(31, 3), F.lit(" "), num(32, 3), F.lit(" "), num(33, 3)), F.concat(F.lit("978-"), num(31, 3), F.lit("-"), num(32, 4))),
    }
    names = list(forms)
    which = pick(0, len(names)).cast("int") + 1
    kind, label = (F.element_at(F.array(*(F.lit(x[k]) for x in names)), which) for k in (0, 1))
    cue = oneof(40, "the ", "and ", "reach me: ", "call ", "card: ", "host ", "mail ", "von ")
    decoy = oneof(41, "order ", "invoice no ", "version ", "serial ", "ISBN ", "ref ", "id: ", "release ")
    before = F.when(kind == "secret", F.when(label == 1, oneof(45, 'token = "', "password: ", "API_KEY=", "secret -> '")).otherwise(oneof(45, "see ", "in ", "the file ", "chapter: "))).otherwise(F.when(label == 1, cue).otherwise(F.when((kind == "card") | (pick(42, 2) == 0), decoy).otherwise(cue)))
    return spark.range(n).select(kind.alias("kind"), label.alias("label"), F.element_at(F.array(*forms.values()), which).alias("match"), before.alias("before"), oneof(43, " ", ".", ",", "\n").alias("after"), pick(44, 4).alias("fold"))


def corpus_examples(found: DataFrame, most: int = MAX_EXAMPLES) -> DataFrame:
    """A sample of the corpus's candidates with their labels, as examples() gives them; folds go by document."""
    kind, match, before = F.col("kind"), F.col("match"), F.col("before")
    judged = found.where(F.col("base") | (kind == "secret"))
    label = F.when(F.col("base"), valid(kind, match)).otherwise(before.rlike(SECRET_WORDS)).cast("int")
    rows = judged.select("kind", label.alias("label"), "match", "before", "after", F.pmod(F.xxhash64(KEY, F.lit("fold")), F.lit(4)).alias("fold"), F.xxhash64(KEY, "kind", "n").alias("pick"))
    return sampled(rows, "pick", most).drop("pick")


def train(spark: SparkSession, found: DataFrame | None = None) -> tuple[list[boosting.Node], dict[str, float]]:
    """The trees, and for each kind the least score at which held-out acceptances are precise enough."""
    labelled = examples(spark) if found is None else examples(spark).unionByName(corpus_examples(found))
    rows = written(labelled.select("kind", "label", "fold", *features()).coalesce(1), "examples")  # MAX_EXAMPLES and 4,000 rows at most
    trees = boosting.fit(rows.where("fold > 0"), FEATURES, "label", rounds=12, depth=3)
    judged = rows.where("fold = 0").select("kind", "label", (F.floor(100 * boosting.probability(trees)) / 100).alias("p"))
    table = judged.groupBy("kind", "p").agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy("kind", F.desc("p")).collect()  # 101 scores a kind at most
    discard(rows)
    limits: dict[str, float] = {}
    for kind in ALL_KINDS:
        good = n = 0
        for r in table:
            if r["kind"] == kind:
                good, n = good + r["good"], n + r["n"]
                if good >= PRECISION * n:
                    limits[kind] = max(r["p"], 0.5)
    return trees, limits


def candidates(rows: DataFrame, text: str) -> DataFrame:
    """All matches of all generators: __row_key, kind, base, start, end, match, before, after."""
    t = F.col(text)
    has = lambda kind: F.instr(t, "@") > 0 if kind == "email" else F.lit(True)
    none = F.array().cast("array<string>")
    one = lambda kind, base, p: F.struct(
        F.lit(kind).alias("kind"),
        F.lit(base).alias("base"),
        F.when(has(kind) if base else F.lit(True), F.split(t, p, -1)).otherwise(none).alias("pieces"),
        F.when(has(kind) if base else F.lit(True), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none).alias("matches"),
    )
    each = [one(k, b, p) for b, ps in ((True, BASE), (False, WIDE)) for k, p in ps.items()]
    found = rows.where(t.rlike("[0-9@(\\[]")).select(KEY, F.inline(F.array(*each))).where(F.size("matches") > 0)
    zipped = F.arrays_zip("pieces", "matches", F.slice("pieces", F.lit(2), F.size("pieces")).alias("rest"))
    found = found.select(KEY, "kind", "base", F.posexplode(zipped).alias("n", "z")).where("z.matches is not null")
    found = found.select(KEY, "kind", "base", "n", F.length("z.pieces").alias("gap"), F.col("z.matches").alias("match"), F.right("z.pieces", F.lit(24)).alias("before"), F.left("z.rest", F.lit(4)).alias("after"))
    found = found.dropDuplicates([KEY, "kind", "base", "n"])  # equal rows share their key and their matches
    so_far = Window.partitionBy(KEY, "kind", "base").orderBy("n")
    end = F.sum(F.col("gap") + F.length("match")).over(so_far)
    return found.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: id_col, __row_key, base and added, both arrays of (start, order, kind, end).

    Positions count code points, ends exclusive. Null and empty texts have no spans;
    repeated rows each get theirs; an empty table gives none; other columns are ignored.
    """
    rows = docs.select(F.col(id_col), F.col(text).alias("__text")).withColumn(KEY, row_key(id_col, "__text"))
    spans = written(candidates(rows.select(KEY, "__text"), "__text"), "candidates")
    trees, limits = train(docs.sparkSession, spans)
    check = F.when(F.col("base") | F.col("kind").isin("card", "phone"), valid(F.col("kind"), F.col("match"))).otherwise(True)
    scored = spans.select(KEY, "kind", "start", "end", "base", check.alias("ok"), *(F.when(~F.col("base"), x).alias(n) for n, x in zip(FEATURES, features()))).where("ok")
    limit = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in limits.items()), F.lit(2.0))
    scored = scored.withColumn("p", F.when(~F.col("base"), boosting.probability(trees))).where(F.col("base") | (F.col("p") >= limit))
    order = F.coalesce(*(F.when(F.col("kind") == k, F.lit(n)) for n, k in enumerate(ALL_KINDS)))
    scored = scored.select(KEY, "kind", order.alias("order"), "start", "end", "base", "p")
    # A proposal may not touch a base span on either side.
    by_start = Window.partitionBy(KEY).orderBy("start", F.desc("base"), "end", "order")
    before, behind = by_start.rowsBetween(Window.unboundedPreceding, -1), by_start.rowsBetween(1, Window.unboundedFollowing)
    base_end, base_start = F.max(F.when(F.col("base"), F.col("end"))).over(before), F.min(F.when(F.col("base"), F.col("start"))).over(behind)
    scored = scored.withColumn("e", base_end).withColumn("s", base_start)
    scored = scored.where(F.col("base") | ((F.coalesce("e", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("s"), F.col("end")) >= F.col("end"))))
    # Of proposals that overlap in a chain, the best stays.
    same = Window.partitionBy(KEY, "base").orderBy("start", "end", "order")
    reach = F.max("end").over(same.rowsBetween(Window.unboundedPreceding, -1))
    scored = scored.withColumn("fresh", (F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("int"))
    scored = scored.withColumn("chain", F.sum("fresh").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy(KEY, "base", "chain").orderBy(F.desc("p"), F.desc(F.col("end") - F.col("start")), "start", "order")
    scored = scored.withColumn("rank", F.row_number().over(best)).where("base or rank = 1")
    span = F.struct("start", "order", "kind", "end")
    of = lambda b: F.array_sort(F.collect_list(F.when(F.col("base") == b, span)))
    per_row = scored.groupBy(KEY).agg(of(True).alias("base"), of(False).alias("added"))
    nothing = F.array().cast(per_row.schema["base"].dataType)
    return rows.select(id_col, KEY).join(per_row, KEY, "left").select(id_col, KEY, F.coalesce("base", nothing).alias("base"), F.coalesce("added", nothing).alias("added"))


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """Replaces every span by its kind in angle brackets; columns stay as they are, a null text stays null.

    Spans that overlap become one, named by the first. Only rows with spans are rewritten,
    and of them also the column `length`, if one is named, to the new number of code points.
    Repeated rows are each rewritten; an empty table gives none.
    """
    rows = keyed(docs, id_col, text)
    found = find_spans(docs, id_col, text).select(KEY, F.array_sort(F.concat("base", "added")).alias("__spans")).where(F.size("__spans") > 0).dropDuplicates([KEY])
    joined = rows.join(written(found, "spans"), KEY, "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    t = F.col(ROW)[text]

    def step(acc: Column, s: Column) -> Column:
        outside = s["start"] >= acc["at"]
        piece = F.substring(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(outside, F.concat(acc["out"], F.array(piece, F.concat(F.lit("<"), s["kind"], F.lit(">"))))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("__spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, (acc["at"] + 1).cast("int"), F.length(t))))
    untouched = F.col("__spans").isNull()
    joined = joined.withColumn("__clean", F.when(untouched, t).otherwise(clean))
    changed = {text: F.col("__clean")}
    if length is not None:
        changed[length] = F.when(untouched, F.col(ROW)[length]).otherwise(F.length("__clean").cast(docs.schema[length].dataType))
    return joined.select(*(changed.get(c, F.col(ROW)[c]).alias(c) for c in docs.columns))
