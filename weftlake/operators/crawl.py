"""Selection of what to fetch: globs, limits, increments, robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlake.functions import urls


def select_urls(entries: DataFrame, url: str, order: str, only: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Entries whose path matches a glob, the first ``limit`` of them in order (all if
    the limit is absent or not positive)."""
    out = entries.where(urls.matches_any(url, only or []))
    return out.orderBy(order).limit(limit) if limit and limit > 0 else out


def skip_built(entries: DataFrame, built: DataFrame, path: str, force: Column | None = None) -> DataFrame:
    """Entries that are not built yet, and those that are forced."""
    todo = entries.join(built.select(F.col(path)).distinct(), path, "left_anti")
    if force is None:
        return todo
    return entries.where(F.coalesce(force, F.lit(False))).unionByName(todo.where(~F.coalesce(force, F.lit(False))))


def parse_robots(files: DataFrame, host: str, text: str, agent: str = "*") -> DataFrame:
    """``host, allow, pattern`` of the rules for ``agent``: those of its own group if there
    is one, else of ``*``. Consecutive user-agent lines share the rules that follow."""
    lines = files.select(F.col(host).alias("host"), F.posexplode(F.split(F.col(text), r"\r?\n")).alias("n", "line"))
    clean = F.trim(F.regexp_replace("line", r"#.*", ""))
    lines = lines.select("host", "n", F.lower(F.regexp_extract(clean, r"^([A-Za-z-]+)\s*:", 1)).alias("field"), F.regexp_extract(clean, r"^[A-Za-z-]+\s*:\s*(.*?)\s*\z", 1).alias("value")).where("field in ('user-agent', 'allow', 'disallow')")
    # a robots file is small: its lines are put together again by host and read in order
    rows = lines.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("n", "field", "value"))).alias("l"))
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("open"), F.array().cast("array<struct<agent:string,allow:boolean,pattern:string>>").alias("rules"))

    def step(acc: Column, x: Column) -> Column:
        is_agent = x["field"] == "user-agent"
        agents = F.when(is_agent & acc["open"], F.array_append(acc["agents"], F.lower(x["value"]))).when(is_agent, F.array(F.lower(x["value"]))).otherwise(acc["agents"])
        new = F.transform(acc["agents"], lambda a: F.struct(a.alias("agent"), (x["field"] == "allow").alias("allow"), x["value"].alias("pattern")))
        rules = F.when(is_agent | (x["value"] == ""), acc["rules"]).otherwise(F.concat(acc["rules"], new))
        return F.struct(agents.alias("agents"), is_agent.alias("open"), rules.alias("rules"))

    rules = rows.select("host", F.aggregate("l", start, step)["rules"].alias("r"))
    name = agent.lower().split("/")[0]
    own = F.filter("r", lambda x: x["agent"] == name)
    chosen = F.when(F.size(own) > 0, own).otherwise(F.filter("r", lambda x: x["agent"] == "*"))
    return rules.select("host", F.explode(chosen).alias("x")).select("host", "x.allow", "x.pattern")


def robots_regex(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: ``*`` is any text, a final ``$`` the end."""
    body = F.regexp_replace(pattern, r"([\\.+?()\[\]{}|^$])", r"\\$1")
    body = F.regexp_replace(body, r"\*", ".*")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(body, r"\\[$]\z", r"\\z"))


def allowed(entries: DataFrame, rules: DataFrame, url: str) -> DataFrame:
    """Entries a host's rules allow: the longest matching pattern decides, Allow wins
    ties; hosts without rules and URLs that don't parse are allowed."""
    target = F.concat(urls.path(url), urls.query(url))
    keyed = entries.withColumn("_host", urls.host(url)).withColumn("_t", target)
    hit = keyed.select("_host", "_t").distinct().join(rules.select(F.lower("host").alias("_host"), "allow", "pattern"), "_host").where(F.regexp_like("_t", robots_regex(F.col("pattern"))))
    verdict = hit.groupBy("_host", "_t").agg(F.max_by("allow", F.struct(F.length("pattern"), F.col("allow").cast("int"))).alias("_ok"))
    return keyed.join(verdict, ["_host", "_t"], "left").where(F.coalesce("_ok", F.lit(True))).drop("_host", "_t", "_ok")


def sample_pages(pages: DataFrame, path: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct pages in the order of a seeded hash; all if there are no more."""
    return pages.select(path).distinct().orderBy(F.xxhash64(path, F.lit(seed)), path).limit(n)


def partial_shuffle(items: list, n: int, rng) -> list:
    """``n`` items by a partial Fisher-Yates shuffle with an injected generator of
    numbers in [0, 1); all in order if there are no more. For lists on the driver."""
    pool = list(items)
    if n >= len(pool):
        return pool
    for i in range(max(n, 0)):
        j = i + int(rng() * (len(pool) - i))
        pool[i], pool[j] = pool[j], pool[i]
    return pool[: max(n, 0)]
