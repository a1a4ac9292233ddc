"""URL filters by host-suffix and path-prefix expressions, in SQL functions only.

Every distinct (host, path) is expanded into ``suffix + prefix`` expressions;
the suffixes have as many labels as the rules' hosts have and the prefixes the
lengths of the rules' paths, so a url has at most as many expressions as there
are such pairs, however long it is.  Expressions are joined with the rules on a 32-bit prefix of a digest, the full SHA-256 digests
then confirm the match, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query: action, host, path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    return F.when(at > 0, F.translate(host, UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _digests(df: DataFrame, suffix: Column, prefix: Column) -> DataFrame:
    # The lengths keep (host, path) pairs apart that concatenate alike.
    text = F.concat_ws(":", F.length(suffix).cast("string"), F.concat(suffix, prefix))
    digest = F.sha2(text, 256)
    return df.withColumns({"digest": digest, "short": F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")})


def _labels(host: Column) -> Column:
    """How many labels a host has."""
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The winning rule of each distinct ``(host, path)`` that any rule fits.

    A rule fits its host and all subdomains of it if the path starts with the
    rule's path, compared as characters.  The longest rule (host and path
    together) wins, then the longer host, then ``block``.  Rules with a null
    part are ignored; repeated rules count once.  The forms that reach the
    driver are at most the labels of the deepest host times the lengths of the
    rules' paths, not a row per rule.
    """
    clean = rules.dropna(subset=["action", "host", "path"]).dropDuplicates(["action", "host", "path"])
    rule = _digests(clean.select("action", "host", "path"), F.col("host"), F.col("path")).select(
        "short",
        F.col("digest").alias("rule_digest"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"),
            F.length("host").alias("host_size"),
            (F.col("action") == "block").cast("int").alias("blocks"),
            F.concat("host", "path").alias("rule"),
            "action",
        ).alias("hit"),
    )
    # Distinct pairs (labels of the host, length of the path): what a rule may look like.
    forms = clean.select(_labels(F.col("host")).alias("labels"), F.length("path").alias("n")).distinct().collect()
    pairs = urls.select("host", "path").distinct()
    shapes = F.array(*(F.struct(F.lit(r["labels"]).alias("labels"), F.lit(r["n"]).alias("n")) for r in sorted(forms)))
    shapes = shapes if forms else F.array().cast("array<struct<labels:int,n:int>>")
    fits = F.filter(shapes, lambda r: (r["labels"] <= F.col("has")) & (r["n"] <= F.length("path")))
    wide = pairs.withColumn("has", _labels(F.col("host"))).select("host", "path", F.explode(fits).alias("r"))
    suffix = F.expr("substring_index(host, '.', -r.labels)")
    wide = _digests(wide, suffix, F.expr("left(path, r.n)")).select("host", "path", "short", "digest")
    met = wide.join(rule, "short").where("digest = rule_digest")
    return met.groupBy("host", "path").agg(F.max("hit").alias("hit")).select("host", "path", "hit.rule", "hit.action")


def filter_urls(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``verdict`` is the winning rule's action, else ``default``; ``rule`` is
    null then.  A null url, or one without ``://``, has an empty host and path.
    Columns of ``df`` named like an output are replaced; repeated rows each get
    a row; empty rules leave the default everywhere.
    """
    own = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parts = df.withColumns({"__host": host_of(F.col(url_col)), "__path": path_of(F.col(url_col))})
    parts = parts.select(*own, F.col("__host").alias("host"), F.col("__path").alias("path"))
    hits = match_rules(parts, rules).toDF("h", "p", "rule", "action")
    out = parts.join(hits, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    verdict = F.coalesce("action", F.lit(default)).alias("verdict")
    return out.select(*own, "host", "path", "rule", verdict)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    values = ", ".join(str(r) for r in RULES)
    rules = spark.sql(f"select * from values {values} as t(action, host, path)")
    return filter_urls(pages, rules).drop("url")


QUERIES = {"op9_url_filters": op9_url_filters}
ORACLES = {
    "op9_url_filters": r"""
        with u as (
            select page_id, case when strpos(url, '://') > 0
                then substr(url, strpos(url, '://') + 3) else '' end as rest
            from pages
        ), hp as (
            select page_id,
                translate(regexp_extract(rest, '^([^/?#]*)', 1),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
            from u
        ), r(action, h, p) as (
            values ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                   ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
        ), w as (
            select hp.page_id, r.h || r.p as rule, r.action,
                row_number() over (partition by hp.page_id order by length(r.h || r.p) desc) as k
            from hp join r on (hp.host = r.h or ends_with(hp.host, '.' || r.h)) and starts_with(hp.path, r.p)
        )
        select hp.page_id, hp.host, hp.path, w.rule, coalesce(w.action, 'allow') as verdict
        from hp left join w on w.page_id = hp.page_id and w.k = 1
    """
}
