"""URL filters: rules on host and path, and gradient-boosted trees where no rule fits.

Everything is DataFrame and SQL functions (and Spark's own boosted trees), so URLs
never leave the JVM. The trees learn from the URLs that a rule decides: lengths,
depth, digit ratio, character entropy, parameter and hyphen counts, and the smoothed
share of blocked URLs among all that end in the same one or two host labels or in the
same file ending. A labelled URL's shares leave out its own fold (one of ``FOLDS``, by
host), so its own label is not among what it is learned from; and each sampled URL is
shown once more with its suffixes taken as unknown, so that the trees judge unknown
suffixes by the other features. The statistics cover all labelled URLs; the trees are
fitted on ``sample_rows`` of them at most, taken in hash order and stored once.

Defined cases: a null URL, or one without ``://``, has an empty host and path and
fits no rule; without rule-decided URLs of both kinds, the verdict elsewhere is the
only kind there is (allow if there is none); page ids may be null and repeat; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoplattice.llm.common import stored

#: Rules are written into the plan, so their number is bounded.
MAX_RULES = 1_000
SAMPLE_ROWS = 20_000
FOLDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_labels", "f_depth", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_fragment", "f_secure",
    "f_suffix", "f_suffix_rows", "f_suffix2", "f_suffix2_rows", "f_ending", "f_ending_rows",
]


def with_parts(pages: DataFrame, url_column: str = "url") -> DataFrame:
    """Adds ``host``, lower-cased, and ``path``."""
    at = F.instr(F.col(url_column), "://")
    rest = F.when(at > 0, F.substring(F.col(url_column), at + 3, F.length(url_column))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumns(
        {"host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}
    )


def decision_column(rules: list[tuple[str, str]]) -> Column:
    """``(rule, verdict)`` of the longest rule that fits ``host`` and ``path``, or null; rules are (verdict, ``host/path``)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are written into a plan")
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        of_host = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        decision = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(of_host & F.col("path").startswith(slash + path), decision))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _entropy(column: Column) -> Column:
    """Bits of entropy of a string's characters."""
    n = F.length(column)
    parts = F.transform(
        F.array_distinct(F.split(column, "")),
        lambda c: F.when(c == "", 0.0).otherwise((n - F.length(F.replace(column, c, F.lit("")))) / n),
    )
    return F.coalesce(F.aggregate(parts, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0)), F.lit(0.0))


def _lexical(judged: DataFrame, url_column: str) -> DataFrame:
    url = F.coalesce(F.col(url_column), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    number = lambda c: c.cast("double")
    return judged.withColumns(
        {
            "suffix": F.substring_index("host", ".", -1),
            "suffix2": F.substring_index("host", ".", -2),
            "fold": F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(FOLDS)).cast("int"),
            "ending": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1),
            "f_length": number(F.length(url)),
            "f_host_length": number(F.length("host")),
            "f_path_length": number(F.length("path")),
            "f_labels": number(F.size(F.split("host", r"\."))),
            "f_depth": number(F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))),
            "f_digits": F.coalesce(number(F.regexp_count(url, F.lit("[0-9]"))) / F.greatest(F.length(url), F.lit(1)), F.lit(0.0)),
            "f_entropy": _entropy(url),
            "f_params": F.when(query == "", 0.0).otherwise(number(F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit("")))) + 1),
            "f_hyphens": number(F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))),
            "f_fragment": number(F.instr(url, "#") > 0),
            "f_secure": number(url.startswith("https")),
        }
    )


def _with_shares(lexical: DataFrame, labelled: DataFrame) -> DataFrame:
    """Adds the smoothed share of blocked URLs and their number for each key, out of fold for the labelled ones."""
    out = lexical
    for key in ("suffix", "suffix2", "ending"):
        folds = [F.sum(F.when(F.col("fold") == k, value).otherwise(0)) for value in (F.col("label"), F.lit(1.0)) for k in range(FOLDS)]
        sums = labelled.groupBy(key).agg(F.sum("label").alias("_blocked"), F.count("*").alias("_rows"), F.array(*folds).alias("_of_fold"))
        own = lambda at: F.when(F.col("label").isNotNull(), F.coalesce(F.get("_of_fold", F.col("fold") + at), F.lit(0.0))).otherwise(0.0)
        blocked, rows = F.coalesce("_blocked", F.lit(0.0)) - own(0), F.coalesce("_rows", F.lit(0)) - own(FOLDS)
        out = out.join(sums, key, "left").withColumns({f"f_{key}": (blocked + 1) / (rows + 2), f"f_{key}_rows": F.log1p(rows)})
        out = out.drop("_blocked", "_rows", "_of_fold")
    return out


def _fitted(labelled: DataFrame, sample_rows: int) -> GBTClassificationModel:
    """Trees on a stored sample, each URL with and without what is known of its suffixes; both kinds weigh the same."""
    sample = labelled.select("_id", "_url", "label", *FEATURES).orderBy(F.xxhash64("_id", "_url"), "_id", "_url").limit(sample_rows)
    unknown = {name: F.lit(0.0 if name.endswith("_rows") else 0.5) for name in FEATURES if name.startswith(("f_suffix", "f_ending"))}
    sample = stored(sample.drop("_id", "_url"), "url-sample")
    blocked = sample.agg(F.avg("label")).first()[0]
    weight = F.when(F.col("label") == 1, 0.5 / max(blocked, 1e-9)).otherwise(0.5 / max(1 - blocked, 1e-9))
    both = sample.unionByName(sample.withColumns(unknown)).withColumn("weight", weight)
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(both).select("features", "label", "weight")
    return GBTClassifier(maxIter=10, maxDepth=3, stepSize=0.3, maxBins=32, seed=11, weightCol="weight").fit(assembled)


def _scored(full: DataFrame, labelled: DataFrame, sample_rows: int) -> tuple[DataFrame, Column]:
    """``full`` with the trees' output, and the column of their probability of block; without both kinds, the only kind there is."""
    kinds = {r["label"] for r in labelled.select("label").distinct().collect()}
    if len(kinds) < 2:
        return full, F.lit(1.0 if kinds == {1.0} else 0.0)
    trees = _fitted(labelled, sample_rows)
    return trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(full)), vector_to_array("probability")[1]


def _featured(pages: DataFrame, rules: list[tuple[str, str]], id_column: str, url_column: str) -> DataFrame:
    source = pages.select(F.col(id_column).alias("_id"), F.col(url_column).alias("_url"))
    judged = with_parts(source, "_url").withColumn("decision", decision_column(rules))
    judged = judged.withColumns({"rule": F.col("decision.rule"), "ruled": F.col("decision.verdict")}).drop("decision")
    label = F.element_at(F.create_map(F.lit("block"), F.lit(1.0), F.lit("allow"), F.lit(0.0)), F.col("ruled"))
    lexical = _lexical(judged, "_url").withColumn("label", label)
    return _with_shares(lexical, lexical.where("label is not null"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], sample_rows: int = SAMPLE_ROWS, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict, score)``; ``score`` is the trees' probability of block, null where a rule decides."""
    full = _featured(pages, rules, id_column, url_column)
    scored, score = _scored(full, full.where("label is not null"), sample_rows)
    method = F.when(score >= 0.5, "block").otherwise("allow")
    return scored.select(
        F.col("_id").alias(id_column), "host", "path", "rule",
        F.coalesce("ruled", method).alias("verdict"), F.when(F.col("ruled").isNull(), score).alias("score"),
    )


def held_out(pages: DataFrame, rules: list[tuple[str, str]], sample_rows: int = SAMPLE_ROWS, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``(label, score)`` of the rule-decided URLs of one fold of hosts, from trees and shares that know the other folds alone."""
    full = _featured(pages, rules, id_column, url_column)
    scored, score = _scored(full.where("label is not null and fold = 0"), full.where("label is not null and fold <> 0"), sample_rows)
    return scored.select("label", score.alias("score"))
