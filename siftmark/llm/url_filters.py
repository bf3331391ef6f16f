"""URL filters: rules by host and path, and association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import durable, read

#: Verdict by host and path.
BASE = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: A mined rule blocks so large a share of the labelled URLs that fit it, at least.
MIN_CONFIDENCE = 0.6
#: It is right for so many labelled URLs, and for so large a share of all of them, at least.
MIN_URLS, MIN_SUPPORT = 10, 0.0005
#: While no labelled URL has more host labels (counted from the last), path segments and parameters (from the first), all its tokens are items of their own. Of a URL that has more all are mined too, those of its tokens that come together always as one item: any set of a frequent URL's tokens is an itemset.
HOST_TOKENS, PATH_TOKENS, QUERY_TOKENS = 4, 3, 3
_BLOCKED = "blocked"
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def with_parts(urls: DataFrame) -> DataFrame:
    """urls with host, path and query: the host after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased, the path from there up to `?`, `#` or the end, the query between `?` and `#`. All are empty without `://`."""
    after = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    return (
        urls.withColumn("after", F.expr(after))
        .withColumn("host", F.expr(f"translate(regexp_extract(after, '^[^/?#]*', 0), {_LETTERS})"))
        .withColumn("path", F.regexp_extract("after", r"^[^/?#]*([^?#]*)", 1))
        .withColumn("query", F.regexp_extract("after", r"^[^?#]*\?([^#]*)", 1))
        .drop("after")
    )


def _base_rule() -> Column:
    """The longest of BASE that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(BASE, key=len):  # a longer one stands outside
        host, slash, path = rule.partition("/")
        fits = F.col("path").startswith(slash + path) & ((F.col("host") == host) | F.col("host").endswith("." + host))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _tokens(mined: bool) -> Column:
    """Distinct tokens: host labels (h:), path segments (p:) and parameters (q:), with every run of digits as 0 and A-Z lower-cased."""
    plain = lambda c: F.regexp_replace(F.expr(f"translate({c}, {_LETTERS})"), "[0-9]+", "0")
    part = lambda c, by, first: F.transform(F.filter(F.split(plain(c), by), lambda x: x != ""), lambda x: F.concat(F.lit(first), x))
    host, path, query = part("host", r"\.", "h:"), part("path", "/", "p:"), part("query", "&", "q:")
    if mined:
        host = F.slice(F.reverse(host), 1, HOST_TOKENS)
        path, query = F.slice(path, 1, PATH_TOKENS), F.slice(query, 1, QUERY_TOKENS)
    return F.array_sort(F.array_distinct(F.concat(host, path, query)))


def _with_items(rows: DataFrame) -> DataFrame:
    """rows (id, near, items, blocked) with the items to be mined: the tokens, but of those of rows that have some beyond near, one for all that are in the same rows."""
    far = rows.where(F.size(F.array_except("items", "near")) > 0).select(F.explode("items").alias("token")).distinct()
    if far.isEmpty():
        return rows
    tokens = rows.select("id", "blocked", F.explode_outer("items").alias("token"))
    where = [F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(f"rows_{seed}") for seed in range(2)]
    held = tokens.join(far, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"), *where)
    alike = held.groupBy("n", "rows_0", "rows_1").agg(F.min("token").alias("first"), F.collect_list("token").alias("tokens"))
    named = alike.select("first", F.explode("tokens").alias("token"))
    return tokens.join(named, "token", "left").groupBy("id", "blocked").agg(F.array_sort(F.collect_set(F.coalesce("first", "token"))).alias("items"))


def mine_rules(labelled: DataFrame) -> DataFrame:
    """tokens, confidence, n_urls: combinations of URL tokens whose labelled URLs are mostly to be blocked.

    labelled: url, blocked (boolean). Spark's FP-growth counts the frequent combinations of tokens, the label among
    them; a combination is a rule if at least MIN_CONFIDENCE of the URLs that hold it are to be blocked, and these are
    MIN_URLS and MIN_SUPPORT of all at least. Rows of null url or label are left out, repeated rows count each. All
    tokens of a URL are mined; of the tokens of URLs beyond the fixed numbers that come in the same URLs always, rules
    name the first.
    """
    rows = with_parts(labelled.select("url", "blocked").where("url IS NOT NULL AND blocked IS NOT NULL")).select(_tokens(True).alias("near"), _tokens(False).alias("items"), "blocked")
    rows = _with_items(durable(rows.withColumn("id", F.monotonically_increasing_id())))
    rows = durable(rows.select(F.when(F.col("blocked"), F.concat("items", F.array(F.lit(_BLOCKED)))).otherwise(F.col("items")).alias("items")))
    n = rows.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, confidence double, n_urls long")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(MIN_SUPPORT, (MIN_URLS - 0.5) / n)), minConfidence=MIN_CONFIDENCE).fit(rows)
    rules = model.associationRules.where(F.element_at("consequent", 1) == _BLOCKED)
    return durable(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", F.round(F.col("support") * n).cast("long").alias("n_urls")))


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens, mined_rule, confidence: of each set of tokens the surest rule that it holds (then the one with most URLs, then the first by its tokens); sets that hold none are left out.

    The inverted index has each rule under the one of its tokens that fewest rules have, so that a set meets few rules;
    the others are looked up in the set.
    """
    holders = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posted = rules.select("tokens", "confidence", "n_urls", F.explode("tokens").alias("token")).join(holders, "token")
    index = posted.groupBy("tokens", "confidence", "n_urls").agg(F.min(F.struct("n", "token")).alias("least")).select(F.col("least.token").alias("token"), F.col("tokens").alias("rule"), "confidence", "n_urls")
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("rule", "tokens")) == 0)
    name = F.array_join("rule", " ")
    best = F.min(F.struct((-F.col("confidence")).alias("confidence"), (-F.col("n_urls")).alias("n_urls"), name.alias("rule"))).alias("best")
    return met.groupBy("tokens").agg(best).select("tokens", F.col("best.rule").alias("mined_rule"), (-F.col("best.confidence")).alias("confidence"))


def judge_urls(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence: one row per row.

    rule is the longest of BASE that fits the URL's host (or a parent domain) and the begin of its path; its verdict
    decides. Where none fits, a mined rule (mine_rules) blocks the URL, and all others are allowed. Null URLs and those
    without `://` have an empty host and path and are allowed. A null page_id is kept, repeated rows each keep theirs,
    and columns other than page_id and url are not read.
    """
    judged = with_parts(pages.select("page_id", "url")).withColumn("rule", _base_rule())
    keyed = judged.withColumn("tokens", F.when(F.col("rule").isNull(), _tokens(False)))
    rules = mine_rules(labelled)
    if rules.isEmpty():
        mined = keyed.withColumn("mined_rule", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    else:
        # digits count alike, so far fewer sets than URLs are matched
        mined = keyed.join(match_rules(keyed.select("tokens").where("size(tokens) > 0").distinct(), rules), "tokens", "left")
    verdict = F.when(F.col("rule").isNotNull(), F.create_map(*(F.lit(x) for pair in BASE.items() for x in pair))[F.col("rule")]).when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return mined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mined_rule", "confidence")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, blocked: the URLs of pages that show a labelled document, which the last number of their path names. Bad quality and toxic documents are to be blocked."""
    number = F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS bigint)")
    shown = with_parts(pages.select("url")).select("url", number.alias("doc_id"))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marked = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(F.max(bad).alias("blocked"))
    return shown.join(marked, "doc_id").select("url", "blocked")


def op12_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge_urls(pages, labelled_pages(pages, read(spark, sf_dir, "labels")))


def _sql() -> str:
    after = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    cases = " ".join(f"WHEN starts_with(path, '/{path}') AND (host = '{host}' OR suffix(host, '.{host}')) THEN '{host}/{path}'" for host, _, path in (r.partition("/") for r in sorted(BASE, key=len, reverse=True)))
    verdicts = " ".join(f"WHEN '{rule}' THEN '{v}'" for rule, v in BASE.items())

    def tokens(c: str, by: str, first: str) -> str:
        return f"list_transform(list_filter(string_split(regexp_replace(translate({c}, {_LETTERS}), '[0-9]+', '0', 'g'), '{by}'), lambda x: x <> ''), lambda x: '{first}' || x)"

    host, path, query = tokens("host", ".", "h:"), tokens("path", "/", "p:"), tokens("query", "&", "q:")
    some = f"list_concat(list_reverse({host})[1:{HOST_TOKENS}], ({path})[1:{PATH_TOKENS}], ({query})[1:{QUERY_TOKENS}])"
    return rf"""
WITH u AS (SELECT row_number() OVER () AS row, page_id, url, {after} AS after FROM pages),
p AS (SELECT row, page_id, url, translate(regexp_extract(after, '^[^/?#]*'), {_LETTERS}) AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(after, '^[^?#]*\?([^#]*)', 1) AS query FROM u),
marked AS (SELECT doc_id, max(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
shown AS (SELECT row, list_sort(list_distinct({some})) AS ts, bad FROM p JOIN marked ON doc_id = try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) WHERE url IS NOT NULL),
subsets AS (SELECT bad, list_filter(ts, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS ts FROM (SELECT ts, bad, unnest(range(1, 1 << len(ts))) AS mask FROM shown)),
rules AS (SELECT ts, count(*) FILTER (bad) AS n_urls, count(*) FILTER (bad) / count(*) AS confidence FROM subsets GROUP BY ts
  HAVING count(*) FILTER (bad) >= greatest({MIN_URLS}, {MIN_SUPPORT} * (SELECT count(*) FROM shown)) AND count(*) FILTER (bad) / count(*) >= {MIN_CONFIDENCE}),
base AS (SELECT row, page_id, host, path, CASE {cases} END AS rule, list_distinct(list_concat({host}, {path}, {query})) AS ts FROM p),
mined AS (SELECT row, arg_min(struct_pack(r := array_to_string(r.ts, ' '), c := confidence), (-confidence, -n_urls, array_to_string(r.ts, ' '))) AS m FROM base JOIN rules r ON rule IS NULL AND list_has_all(base.ts, r.ts) GROUP BY row)
SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE CASE WHEN m IS NULL THEN 'allow' ELSE 'block' END END AS verdict, m.r AS mined_rule, m.c AS confidence FROM base LEFT JOIN mined USING (row)
"""


SQL = {"op12_url_association_rules": _sql()}
QUERIES = {"op12_url_association_rules": op12_url_association_rules}
