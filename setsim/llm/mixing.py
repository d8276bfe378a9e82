"""Mixing documents to target domain weights, in SQL functions only.

A naive Bayes classifier over a few binned counts (words of each domain's lexicon, marks,
capitals, repeats), fitted to a bounded sample of labelled rows, gives every document
a posterior over the domains: soft membership. Rates r >= 0 are then fitted so that the
expected tokens of each domain, the sum of r * tokens * posterior, match the targets:
projected gradient steps on the least-squares distance, started at rate 1 for every
document and preconditioned by the Gram matrix of the documents that are not at zero. A step is one aggregate of as
many sums as there are domains over a written table of tokens and posteriors; a rate is an
expression of the steps taken, so no per-document state is shuffled or kept.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import KEY, row_key, sampled, written

#: Most labelled rows the classifier is fitted to; its lexica have all of their words that pass a test.
MAX_LABELLED = 8_000
#: Half the likelihood-ratio statistic that a word of a lexicon must pass.
LEAST_GAIN = 15.0
#: Odds from which a word alone tells a domain.
STRONG = 16.0
BINS, SMOOTHING = 10, 0.5
SHARES = ["__marks", "__capitals", "__repeats"]
SPACE = r"[ \t-\r]+"
#: Characters whose shares are features: marks, and capital letters.
MARKS, CAPITALS = "[#*$%&|<>!]", "[A-Z]"
MAX_STEPS, TOLERANCE = 40, 1e-4


def label_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The domains clean, low and toxic of a label table; one row per id, the worst label counts."""
    rank = F.when(F.col("quality") == 0, 2).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 0)
    worst = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(rank).alias("r")).where("r is not null")
    return worst.select(id_col, F.element_at(F.array(F.lit("clean"), F.lit("toxic"), F.lit("low")), F.col("r") + 1).alias("domain"))


def with_words(rows: DataFrame, text: str) -> DataFrame:
    """Adds __words, the lower-cased words, n_tokens, and a bin from 0 to 9 of each share."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumn("__words", F.array_remove(F.split(F.lower(t), SPACE), ""))
    share = lambda chars: F.regexp_count(t, F.lit(chars)) / F.greatest(F.length(t), F.lit(1))
    binned = lambda x: F.least(F.floor(x * 10), F.lit(BINS - 1)).cast("int")
    n = F.size("__words")
    repeats = 1 - F.size(F.array_distinct("__words")) / F.greatest(n, F.lit(1))
    return rows.withColumns({"n_tokens": n.cast("long"), "__marks": binned(2 * share(MARKS)), "__capitals": binned(share(CAPITALS)), "__repeats": binned(repeats)})


def among(column: str, words: list[str]) -> Column:
    """The elements of an array column that are among the words: one look-up each in a set that is built once, not per row."""
    listed = ", ".join(f"cast(X'{w.encode().hex()}' AS string)" for w in words)  # as bytes, no word can upset the parser
    return F.expr(f"filter(`{column}`, w -> w IN ({listed}))")


def with_hits(rows: DataFrame, lexica: list[list[str]]) -> DataFrame:
    """Adds for each lexicon how many of its words a row has: exact up to 4, then by doublings, 80 and more alike."""
    size = lambda words: F.size(among("__known", words)) if words else F.lit(0)
    every = [w for words in lexica for w in words]
    rows = rows.withColumn("__known", F.array_distinct(among("__words", every)) if every else F.array().cast("array<string>"))
    binned = lambda n: F.when(n < 5, n).otherwise(F.least(5 + F.floor(F.log2(n / 5)), F.lit(BINS - 1))).cast("int")
    hit = rows.withColumns({f"__n{k}": size(words) for k, words in enumerate(lexica)})
    return hit.withColumns({f"__hits{k}": binned(F.col(f"__n{k}")) for k in range(len(lexica))})


def fit_lexica(labelled: DataFrame, domains: list[str]) -> list[list[str]]:
    """For each domain two lists of words that point to it: at least twice as likely there as elsewhere, and STRONG times.

    All words whose likelihood-ratio statistic against independence of the domain is beyond
    what chance could explain; no more reach the driver than the bounded sample has.
    """
    per = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # one row a domain
    n_d = [per.get(d, 0) for d in domains]
    total = max(sum(n_d), 1)
    seen = labelled.select("domain", F.explode(F.array_distinct("__words")).alias("w")).groupBy("w").agg(*(F.sum((F.col("domain") == d).cast("long")).alias(f"c{k}") for k, d in enumerate(domains)))
    all_c: Column = sum((F.col(f"c{k}") for k in range(len(domains))), F.lit(0))
    term = lambda c, expected: F.when((c > 0) & (expected > 0), c * F.log(c / expected)).otherwise(0.0)
    gain: Column = F.lit(0.0)
    for k, n in enumerate(n_d):
        c, part = F.col(f"c{k}"), n / total
        gain = gain + term(c, all_c * part) + term(F.lit(n) - c, (F.lit(total) - all_c) * part)
    kept = seen.withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN).orderBy(F.desc("gain"), "w").collect()
    lexica: list[list[str]] = [[] for _ in range(2 * len(domains))]
    for r in kept:
        here = [r[f"c{k}"] for k in range(len(domains))]
        lift = [(c + SMOOTHING) / (n + 1) * (total - n + 1) / (sum(here) - c + SMOOTHING) for c, n in zip(here, n_d)]
        best = max(range(len(domains)), key=lift.__getitem__)
        if lift[best] >= 2:
            lexica[2 * best + (lift[best] >= STRONG)].append(r["w"])
    return lexica


def fit_tables(labelled: DataFrame, domains: list[str], groups: list[str]) -> tuple[list[float], dict[str, list[list[float]]]]:
    """Log prior, and for each group of bins the log chance of each bin in each domain."""
    cells = F.array(*(F.struct(F.lit(g).alias("g"), F.col(g).alias("bin")) for g in groups))
    got = labelled.select("domain", F.explode(cells).alias("c")).groupBy("domain", "c.g", "c.bin").agg(F.count("*").alias("n")).collect()  # domains x groups x BINS rows at most
    counts = {(r["domain"], r["g"], r["bin"]): r["n"] for r in got}
    n_d = [sum(counts.get((d, groups[0], b), 0) for b in range(BINS)) for d in domains]
    tables = {g: [[math.log((counts.get((d, g, b), 0) + SMOOTHING) / (n + SMOOTHING * BINS)) for d, n in zip(domains, n_d)] for b in range(BINS)] for g in groups}
    return [math.log((n + 1) / (sum(n_d) + len(domains))) for n in n_d], tables


def posterior(prior: list[float], tables: dict[str, list[list[float]]]) -> Column:
    """The posteriors of a row as an array, in the order of the domains."""
    logs = []
    for k, x in enumerate(prior):
        total = F.lit(float(x))
        for g, table in tables.items():
            total = total + F.element_at(F.array(*(F.lit(row[k]) for row in table)), F.col(g) + 1)
        logs.append(total)
    both = F.array(*logs)
    return F.transform(both, lambda x: 1 / F.aggregate(both, F.lit(0.0), lambda acc, y: acc + F.exp(F.least(y - x, F.lit(700.0)))))


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination with pivoting, for a matrix of the domains' size."""
    n = len(right)
    m = [[*row, right[k]] for k, row in enumerate(matrix)]
    for k in range(n):
        p = max(range(k, n), key=lambda i: abs(m[i][k]))
        m[k], m[p] = m[p], m[k]
        for i in range(n):
            if i != k and m[k][k]:
                f = m[i][k] / m[k][k]
                m[i] = [a - f * b for a, b in zip(m[i], m[k])]
    return [m[k][n] / m[k][k] if m[k][k] else 0.0 for k in range(n)]


def fit_rates(soft: DataFrame, targets: dict[str, float], epochs: float = 1.0, steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> Column:
    """The fitted rate as an expression of n_tokens and posterior (an array, in the order of targets).

    The steps are a constant that one loop runs over, so plans have the same size after any
    number of them; written out as nested expressions, 40 steps took the driver hundreds of MB.

    Rates that still miss a target after all steps, as they must if no document can supply a
    domain, are the least-squares ones so far, and a warning names the distance.
    """
    k = range(len(targets))
    n, p = F.col("n_tokens").cast("double"), [F.col("posterior")[i] for i in range(len(targets))]
    total = soft.agg(F.sum(n)).first()[0] or 0.0
    size = total * epochs
    wanted = [size * w / sum(targets.values()) for w in targets.values()]
    moves: list[list[float]] = []

    def moved(r: Column, m: Column) -> Column:
        move: Column = F.lit(0.0)
        for i in k:
            move = move + p[i] * m[i]
        return F.greatest(F.lit(0.0), r + move)

    def after() -> Column:
        return F.aggregate(F.array(*(F.array(*map(F.lit, m)) for m in moves)), F.lit(1.0), moved) if moves else F.lit(1.0)

    for _ in range(steps if total else 0):
        rate = F.col("__rate")
        free = n * F.when(rate > 0, 1.0).otherwise(0.0)
        sums = [F.sum(n * p[i] * rate).alias(f"t{i}") for i in k] + [F.sum(free * p[i] * p[j]).alias(f"g{i}_{j}") for i in k for j in k if i <= j]
        got = soft.withColumn("__rate", after()).agg(*sums).first()
        left = [wanted[i] - (got[f"t{i}"] or 0.0) for i in k]
        if max(map(abs, left)) <= tolerance * size:
            break
        gram = [[got[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in k] for i in k]
        for i in k:
            gram[i][i] += 1e-6 * total
        moves.append(solve(gram, left))
    else:
        if total and steps:
            warnings.warn(f"after {steps} steps a domain still misses its target by {max(map(abs, left)) / size:.4f} of all tokens", stacklevel=2)
    return after()


def soft_membership(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text: str, keep: tuple[str, ...] = (), max_labelled: int = MAX_LABELLED) -> DataFrame:
    """A written table id_col, __row_key, keep, n_tokens, posterior; one row per input row."""
    rows = docs.select(F.col(id_col), *keep, F.col(text).alias("__text")).withColumn(KEY, row_key(id_col, "__text"))
    sample = written(sampled(labelled.where(F.col("domain").isin(domains)), id_col, max_labelled), "labelled")  # max_labelled ids at most
    training = with_words(rows.join(F.broadcast(sample), id_col), "__text").select("domain", "__words", *SHARES)
    # Copies would count a text's chance words as evidence again and again: of texts with the same four least word hashes one is learnt from.
    least = F.slice(F.array_sort(F.transform(F.array_distinct("__words"), lambda w: F.xxhash64(w))), 1, 4)
    training = written(training.withColumn("__least", least).groupBy("domain", "__least").agg(F.min_by(F.struct("__words", *SHARES), F.xxhash64("__words")).alias("one")).select("domain", "one.*"), "training")
    lexica = fit_lexica(training, domains)
    groups = [*SHARES, *(f"__hits{k}" for k in range(len(lexica)))]
    prior, tables = fit_tables(written(with_hits(training, lexica).select("domain", *groups), "bins"), domains, groups)
    binned = with_hits(with_words(rows, "__text"), lexica)
    return written(binned.select(id_col, *keep, KEY, "n_tokens", posterior(prior, tables).alias("posterior")), "soft")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), epochs: float = 1.0) -> DataFrame:
    """For each row: id_col, keep, __row_key, n_tokens, posterior, rate, n_copies.

    `labelled` has id_col and domain; targets gives each domain's share of the tokens
    wanted, whose sum is epochs times the tokens there are. n_copies rounds the rate up or down
    by a hash of the row, so its expectation is the rate. Null, empty and wordless texts have no
    tokens and do not count; without labels all domains are alike. Repeated rows get equal
    rates; an empty table gives none; other columns are ignored.
    """
    soft = soft_membership(docs, labelled, list(targets), id_col, text, keep)
    out = soft.withColumn("rate", fit_rates(soft, targets, epochs))
    share = F.pmod(F.xxhash64(KEY, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + (share < F.col("rate") - F.floor("rate")).cast("long")
    return out.withColumn("n_copies", copies)


def mix_rows(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text: str = "text", epochs: float = 1.0, repeat: bool = False) -> DataFrame:
    """The rows of docs that get a copy at least, with rate and n_copies; both replace columns so named.

    With repeat, each row is there n_copies times. Null and wordless texts have no tokens to
    weigh and get the rate of their posterior; repeated rows each count; an empty table gives none.
    """
    whole = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__t"), F.struct(*docs.columns).alias("__row"))
    mixed = mix(whole, labelled.withColumnRenamed(id_col, "__id"), targets, "__id", "__t", keep=("__row",), epochs=epochs).where("n_copies > 0")
    rest = [c for c in docs.columns if c not in ("rate", "n_copies")]
    if repeat:
        mixed = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "n_copies")))
    return mixed.select(*(F.col("__row")[c].alias(c) for c in rest), "rate", "n_copies")
