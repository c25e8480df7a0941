"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join. DataFrame functions only.

A rule is a canonical URL, host and path prefix written together (``example.org/es/``), with the verdict
``allow`` or ``block``. It fits its host and all subdomains where the path starts with the rule's; the longest
rule wins (ties: the longer host, then the smaller text). A URL that no rule fits gets ``default``.

Method. Only keys that could equal a rule are made of a URL: for each (number of host labels, path length) that
some rule has, the last labels of the host and the first characters of the path. These shapes (as many as URLs have
numbers of labels and lengths, whatever the list's length) are one constant array of the plan. Keys meet a register-blocked
Bloom filter (64-bit blocks, 4 bits a key; the block and the bits come from one xxhash64). The filter is a
constant of the plan of at most ``max_blocks`` words whatever the list's length: a longer list gives more
false positives, never a wrong verdict. Passing keys are joined exactly with the rules, on distinct
(host, path) pairs, and the verdicts are joined back under a salt, so a hot URL is spread over ``salt`` tasks besides
what adaptive execution splits.

Cases: null URL or no ``://``: host and path are empty and the default applies. Null ids, repeated rows and
further columns are kept as they are, except that input columns named like an output (host, path, rule, verdict) are
replaced. Empty tables give empty results. An empty rule list gives the default everywhere; a rule without ``/`` fits
all paths of its host, a null rule nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, unused

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def _h(c: Column) -> Column:
    return F.xxhash64(c)


def _mask(h: Column) -> Column:
    one = F.lit(1).cast("long")
    m = None
    for k in range(4):
        bit = F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
        m = bit if m is None else m.bitwiseOR(bit)
    return m


def _block(h: Column, n: int) -> Column:
    return F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(n - 1)).cast("int")


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_blocks: int = 4096, salt: int = 16) -> DataFrame:
    """pages with host, path, rule and verdict. rules: (rule string, verdict string); null or repeated rules count once."""
    rules = (
        rules.where(F.col("rule").isNotNull())
        .groupBy("rule").agg(F.min("verdict").alias("verdict"))
        .withColumn("rule_host", F.substring_index("rule", "/", 1))
        .withColumn("n_labels", F.size(F.split("rule_host", r"\.")))
        .withColumn("n_path", F.length("rule") - F.length("rule_host"))
    )
    # what the driver knows of the list: its shapes (as many as URLs have lengths) and at most max_blocks filter words
    shapes = sorted((r[0], r[1]) for r in rules.select("n_labels", "n_path").distinct().collect())
    n_rules = rules.count()
    n_blocks = 64
    while n_blocks < max_blocks and n_blocks * 4 < n_rules:
        n_blocks *= 2
    h = _h(F.col("rule"))
    if n_rules > 4 * max_blocks:
        return _by_table(pages, rules, shapes, n_rules, url, default, salt)
    words = dict(rules.groupBy(_block(h, n_blocks).alias("b")).agg(F.bit_or(_mask(h)).alias("w")).collect())
    bits = F.from_json(F.lit("[" + ",".join(str(words.get(i, 0)) for i in range(n_blocks)) + "]"), "array<bigint>")

    host, path = parse(F.col(url))
    out = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    every = F.from_json(F.lit("[" + ",".join(f'{{"n":{n},"p":{p}}}' for n, p in shapes) + "]"), "array<struct<n int, p int>>")

    def key(x: Column) -> Column:
        return _keys_of(x, F.col("host"), F.col("path"))

    def may(k: Column) -> Column:
        m = _mask(_h(k))
        return k.isNotNull() & (F.element_at(bits, _block(_h(k), n_blocks) + 1).bitwiseAND(m) == m)

    keys, salted = unused([*out.columns, "rule", "verdict"], "_keys", "_salt")
    out = out.withColumn(keys, F.filter(F.transform(every, key), may))
    best = (
        out.where(F.size(keys) > 0).select("host", "path", keys).distinct()
        .select("host", "path", F.explode(keys).alias("rule"))
        .join(rules.select("rule", "verdict", "rule_host"), "rule")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule", "verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
        .withColumn(salted, F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    )
    # rows without a possible hit match nothing and are dealt out evenly by their own hash: the URL and the short columns
    short = [c for c, kind in pages.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp") or kind.startswith("decimal")]
    spread = F.xxhash64(url, *(F.col(c) for c in short if c in out.columns)) if url in out.columns else F.xxhash64("host", "path", *(F.col(c) for c in short if c in out.columns))
    out = out.withColumn(salted, F.when(F.size(keys) > 0, F.pmod(spread, F.lit(salt)).cast("int")).otherwise((-1 - F.pmod(spread, F.lit(1 << 20))).cast("int")))
    return out.join(best, ["host", "path", salted], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default))).drop(keys, salted)


def _keys_of(x: Column, host: Column, path: Column) -> Column:
    """The rule that a URL would have to be under for a shape x, null if it is too short for it."""
    end = F.call_function("substring_index", host, F.lit("."), -x["n"])
    return F.when((F.size(F.split(host, r"\.")) >= x["n"]) & (F.length(path) >= x["p"]), F.concat(end, F.substr(path, F.lit(1), x["p"])))


def _by_table(pages: DataFrame, rules: DataFrame, shapes: list[tuple[int, int]], n_rules: int, url: str, default: str, salt: int) -> DataFrame:
    """url_filter for a list whose filter is too large for a plan's constant: a row a block, of four rules each on average.

    Distinct keys of all URLs meet the filter by block number, those that pass the rules; what is left goes back to the
    URLs. A key that very many URLs share is one row until then, and the way back is salted.
    """
    blocks = 1 << max(6, (n_rules // 4).bit_length())
    h = _h(F.col("rule"))
    words = rules.groupBy(_block(h, blocks).alias("b")).agg(F.bit_or(_mask(h)).alias("w"))
    host, path = parse(F.col(url))
    out = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    (salted,) = unused([*out.columns, "rule", "verdict"], "_salt")
    out = out.withColumn(salted, F.pmod(F.xxhash64(url if url in out.columns else "host", F.monotonically_increasing_id()), F.lit(salt)).cast("int"))
    every = F.from_json(F.lit("[" + ",".join(f'{{"n":{n},"p":{p}}}' for n, p in shapes) + "]"), "array<struct<n int, p int>>")
    own = out.select("host", "path").distinct()
    keys = own.select("host", "path", F.explode(F.filter(F.transform(every, lambda x: _keys_of(x, F.col("host"), F.col("path"))), lambda k: k.isNotNull())).alias("rule"))
    asked = keys.select("rule").distinct().withColumn("b", _block(_h(F.col("rule")), blocks))
    passed = asked.join(words, "b").where(F.col("w").bitwiseAND(_mask(_h(F.col("rule")))) == _mask(_h(F.col("rule")))).select("rule")
    hits = passed.join(rules.select("rule", "verdict", "rule_host"), "rule")
    best = (
        keys.join(hits, "rule").groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule", "verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
        .withColumn(salted, F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    )
    return out.join(best, ["host", "path", salted], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default))).drop(salted)


def rules_frame(spark, rules=RULES) -> DataFrame:
    rows = ", ".join(f"('{r}', '{v}')" for r, v in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(rule, verdict)")


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, row_number() OVER () AS r,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rule, rhost, rpath, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
m AS (
  SELECT p.r, rules.rule, rules.verdict, row_number() OVER (PARTITION BY p.r ORDER BY length(rule) DESC, rule) AS k
  FROM p JOIN rules ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.r = p.r AND m.k = 1
"""
