"""URL filter over path templates, DataFrame functions only.

Urls are counted by host and path. Segments that vary become wildcards: by their form (numbers,
long hexadecimal names) and, level by level, where a place under one parent holds many values
that hardly repeat. Branches of one parent whose labelled purity does not differ from the pool of
their siblings are merged. A template is rejected when its purity, smoothed towards its host and
the host towards all labels, falls below a threshold.

Only counts by (host, template) move; urls meet them again by a salted join, so one host with a
third of all rows is spread over tasks. A null url, or one without `://`, has an empty host and
path and is judged like any other. Repeated rows are judged each for itself; without labels, or
for an empty table, nothing is rejected. Columns beyond those named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import ascii_lower, run_folder, staged

ALLOW, BLOCK = "allow", "block"
#: The contract's rules: host and path prefix, verdict.
RULES = {
    "org/": ALLOW,
    "example.org/es/": BLOCK,
    "example.org/en/1": BLOCK,
    "com/fr/": ALLOW,
    "com/de/": BLOCK,
}


@dataclass(frozen=True)
class Settings:
    """depth: segments told apart, the rest of a path is one `**`. children: a place with this many
    values, each seen `repeats` times or less on average, is a wildcard. z: how many standard errors a
    branch must differ from its siblings to stay apart. weight: pseudo-labels of the smoothing.
    purity: what a template needs. salts: tasks that a hot host's urls are spread over."""

    depth: int = 3
    children: int = 8
    repeats: float = 4.0
    z: float = 2.0
    weight: float = 4.0
    purity: float = 0.5
    salts: int = 16


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, or null."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)) if found is None else found.when(fits, F.lit(rule))
    return found if found is not None else F.lit(None).cast("string")


def _segment(k: int) -> str:
    """The k-th segment by its form: numbers and long hexadecimal names lose their value."""
    raw = f"get(_parts, {k})"
    return (
        f"CASE WHEN {raw} IS NULL THEN '' "
        rf"WHEN {raw} RLIKE '^[0-9a-fA-F-]{{16,}}$' THEN '*' "
        rf"ELSE regexp_replace({raw}, '[0-9]+', '#') END"
    )


def shapes(df: DataFrame, url: str, settings: Settings) -> DataFrame:
    """_host, _path and the first segments _s0.. by their form, _rest for deeper ones."""
    df = df.withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url))})
    df = df.withColumn("_parts", F.split(F.regexp_replace("_path", "^/", ""), "/"))
    cols = {f"_s{k}": F.expr(_segment(k)) for k in range(settings.depth)}
    cols["_rest"] = F.when(F.size("_parts") > settings.depth, F.lit("**")).otherwise(F.lit(""))
    return df.withColumns(cols).drop("_parts")


def _totals(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "labels", "good")])


def templates(urls: DataFrame, labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The map of shapes to templates: _host, _s0.., _rest, template, purity, rejected.

    `urls` has url; `labelled` has url and good (boolean or null)."""
    segs = [f"_s{k}" for k in range(settings.depth)]
    shape = ["_host", *segs, "_rest"]
    mine = [f"_t{k}" for k in range(settings.depth)]
    known = F.col("good").isNotNull().cast("long")
    none = F.lit(0).cast("long")
    is_good = F.coalesce(F.col("good").cast("long"), none)
    both = urls.select("url", F.lit(1).cast("long").alias("n"), none.alias("labels"), none.alias("good"))
    both = both.unionByName(labelled.select("url", none.alias("n"), known.alias("labels"), is_good.alias("good")))
    folder = run_folder(urls.sparkSession)
    seen = staged(_totals(shapes(both, "url", settings), shape), folder, "shapes")
    for k in range(settings.depth):  # downwards: places that vary
        parent = ["_host", *mine[:k]]
        values = seen.groupBy(*parent, f"_s{k}").agg(F.sum("n").alias("n"))
        wide = values.groupBy(*parent).agg(F.count("*").alias("_kinds"), F.sum("n").alias("_all"))
        varies = (F.col("_kinds") >= settings.children) & (F.col("_all") <= settings.repeats * F.col("_kinds"))
        seen = seen.join(wide, parent).withColumn(f"_t{k}", F.when(varies, F.lit("*")).otherwise(F.col(f"_s{k}")))
        seen = staged(seen.drop("_kinds", "_all"), folder, f"down{k}")
    for k in reversed(range(settings.depth)):  # upwards: branches that look alike
        place = ["_host", *[m for m in mine if m != f"_t{k}"], "_rest"]
        branch = _totals(seen, ["_host", *mine, "_rest"])
        sums = [F.sum("labels").alias("_pl"), F.sum("good").alias("_pg"), F.count("*").alias("_branches")]
        pool = branch.groupBy(*place).agg(*sums)
        share = F.try_divide("_pg", "_pl")
        gap = F.abs(F.try_divide("good", "labels") - share)
        error = F.sqrt(F.try_divide(share * (1 - share), F.col("labels")))
        alike = F.coalesce((F.col("_branches") > 1) & (F.col("_pl") > 0) & ((F.col("labels") == 0) | (gap <= settings.z * error)), F.lit(False))
        alike = branch.join(pool, place).select("_host", *mine, "_rest", alike.alias("_alike"))
        seen = seen.join(alike, ["_host", *mine, "_rest"])
        merged = F.when(F.col("_alike"), F.lit("*")).otherwise(F.col(f"_t{k}"))
        seen = staged(seen.withColumn(f"_t{k}", merged).drop("_alike"), folder, f"up{k}")
    leaf = ["_host", *mine, "_rest"]
    w = settings.weight
    total = seen.agg(F.sum("labels").alias("_al"), F.sum("good").alias("_ag")).withColumn("_one", F.lit(1))
    hosts = _totals(seen, ["_host"]).select("_host", F.col("labels").alias("_hl"), F.col("good").alias("_hg"))
    prior = F.coalesce(F.try_divide("_ag", "_al"), F.lit(1.0))
    host_purity = (F.col("_hg") + w * F.col("_prior")) / (F.col("_hl") + w)
    purity = (F.col("good") + w * F.col("_hp")) / (F.col("labels") + w)
    hosts = hosts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")  # one row
    hosts = hosts.withColumn("_prior", prior).withColumn("_hp", host_purity)
    judged = _totals(seen, leaf).join(hosts.select("_host", "_hp"), "_host").withColumn("purity", purity)
    judged = judged.withColumn("rejected", F.col("purity") < settings.purity)
    named = F.array_join(F.array_remove(F.array(*mine, F.col("_rest")), ""), "/")
    judged = judged.withColumn("template", F.concat("_host", F.lit("/"), named))
    return seen.select(*shape, *mine).join(judged.select(*leaf, "template", "purity", "rejected"), leaf).select(
        *shape, "template", "purity", "rejected"
    )


def judge_urls(
    pages: DataFrame, labelled: DataFrame, rules: dict[str, str] = RULES, settings: Settings = Settings()
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template and its purity."""
    shape = ["_host", *[f"_s{k}" for k in range(settings.depth)], "_rest"]
    salts = F.explode(F.sequence(F.lit(0), F.lit(settings.salts - 1)))
    known = templates(pages.select("url"), labelled, settings).withColumn("_salt", salts)
    urls = shapes(pages.select("page_id", "url"), "url", settings)
    urls = urls.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(settings.salts)).cast("int"))
    found = urls.join(known, [*shape, "_salt"], "left")
    rule = rule_of(F.col("_host"), F.col("_path"), rules)
    decided = F.coalesce(
        *[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()],
        F.when(F.col("rejected"), F.lit(BLOCK)),
        F.lit(ALLOW),
    )
    return found.withColumn("rule", rule).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), "rule",
        decided.alias("verdict"), "template", F.round("purity", 9).alias("purity"),
    )


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled urls of the sample: a page shows the document whose number is the last number of
    its path, and is as good as that document's quality label."""
    number = F.regexp_extract(path_of(F.col("url")), r"([0-9]{1,18})[^0-9]*$", 1).try_cast("long")
    shown = pages.select("url", number.alias("doc_id")).where("doc_id IS NOT NULL")
    rated = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return shown.join(rated, "doc_id").select("url", (F.col("quality") == 1).alias("good"))
