"""robots.txt as tables: rules, path decisions, and what AI crawlers may fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import encoded, let, url_origin
from ..sources.staging import cut

# Fixed value: bytes of a robots.txt; a longer one cannot be read, so what it says is unknown.
BODY_CAP = 500 * 1024
# The crawler catalog (token, vendor, purpose), in report order.
BOTS = [
    ("GPTBot", "OpenAI", "training"),
    ("OAI-SearchBot", "OpenAI", "ai_search"),
    ("ChatGPT-User", "OpenAI", "user_fetch"),
    ("ClaudeBot", "Anthropic", "training"),
    ("Claude-SearchBot", "Anthropic", "ai_search"),
    ("Claude-User", "Anthropic", "user_fetch"),
    ("PerplexityBot", "Perplexity", "ai_search"),
    ("Perplexity-User", "Perplexity", "user_fetch"),
    ("Google-Extended", "Google", "training"),
    ("CCBot", "Common Crawl", "training"),
    ("Bytespider", "ByteDance", "training"),
]
PURPOSES = ("training", "ai_search", "user_fetch")


def robots_state(status: Column, body: Column | None = None) -> Column:
    """200 is found, 404 absent, anything else (null too) unavailable; so is a file of any status beyond BODY_CAP bytes."""
    state = F.when(status == 200, "found").when(status == 404, "absent").otherwise("unavailable")
    return state if body is None else F.when(F.octet_length(F.coalesce(body, F.lit(""))) > BODY_CAP, "unavailable").otherwise(state)


def bot_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *b) for i, b in enumerate(BOTS)], "ord int, token string, vendor string, purpose string")


def robots_lines(docs: DataFrame) -> DataFrame:
    """(site, ord, key, value) of the lines of found documents; comments are gone. Whole bodies are read."""
    lines = docs.filter(F.col("state") == "found").select("site", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r\n|\r|\n")).alias("ord", "line"))
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    return lines.select("site", "ord", F.lower(F.trim(F.regexp_extract(line, r"^([^:]+):", 1))).alias("key"), F.trim(F.regexp_extract(line, r"^[^:]+:(.*)$", 1)).alias("value")).filter("key <> ''")


def robots_rules(docs: DataFrame) -> DataFrame:
    """(site, group_ord, ua_token, kind, pattern, ord): consecutive user-agent lines share the rules that follow them.

    kind is allow, disallow, crawl_delay (pattern holds the seconds), agent (an agent line itself: its group exists even
    without rules) or sitemap (group 0, no agent). An empty disallow is no rule.
    """
    lines = robots_lines(docs)
    grouped = lines.filter(F.col("key").isin("user-agent", "allow", "disallow", "crawl-delay"))
    order = Window.partitionBy("site").orderBy("ord")
    is_agent = F.col("key") == "user-agent"
    starts = is_agent & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    grouped = grouped.withColumn("starts", starts.cast("int")).withColumn("group_ord", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    agents = grouped.filter(is_agent).select("site", "group_ord", F.lower("value").alias("ua_token"), F.col("ord").alias("agent_ord"))
    rules = grouped.filter(~is_agent & ~((F.col("key") == "disallow") & (F.col("value") == "")) & ~((F.col("key") == "allow") & (F.col("value") == ""))).select("site", "group_ord", F.replace("key", F.lit("-"), F.lit("_")).alias("kind"), F.col("value").alias("pattern"), "ord")
    out = agents.join(rules, ["site", "group_ord"]).select("site", "group_ord", "ua_token", "kind", "pattern", "ord")
    own = agents.select("site", "group_ord", "ua_token", F.lit("agent").alias("kind"), F.lit("").alias("pattern"), F.col("agent_ord").alias("ord"))
    maps = lines.filter("key = 'sitemap'").select("site", F.lit(0).cast("long").alias("group_ord"), F.lit(None).cast("string").alias("ua_token"), F.lit("sitemap").alias("kind"), F.col("value").alias("pattern"), "ord")
    return out.unionByName(own).unionByName(maps)


def pattern_regex(pattern: Column) -> Column:
    """A path pattern with * and a final $ as an anchored expression, each piece atomic, so none is tried twice."""
    ends = pattern.endswith("$")
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"\*+", "*")
    quoted = F.transform(F.split(body, r"\*"), lambda x: F.regexp_replace(x, r"([\\.\[\]{}()+?^|$])", r"\\$1"))
    last = F.size(quoted) - 1
    piece = lambda x, i: F.when(i == 0, x).when(ends & (i == last), F.concat(F.lit(".*"), x)).otherwise(F.concat(F.lit("(?>.*?"), x, F.lit(")")))
    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(quoted, piece), ""), F.when(ends, "$").otherwise(""))


def octets(c: Column) -> Column:
    """Non-ASCII characters and blanks percent-encoded, and the hex digits of what is encoded already in upper case."""
    upper = lambda x, i: F.when((i > 0) & x.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(x, 1, 2)), F.substr(x, F.lit(3)))).otherwise(x)
    return let(encoded(c, r"[^\x21-\x7E]"), lambda e: F.when(e.contains("%"), F.array_join(F.transform(F.split(e, "%"), upper), "%")).otherwise(e))


def filed_rules(rules: DataFrame) -> DataFrame:
    """(site, ua_token, prefix, filed): allow and disallow rules under the literal text before their first *.

    filed holds struct<len, allow, pieces, ends> for each: the text between later asterisks, and whether a final $ ends
    the path. What shares a prefix is one row; a file's cap bounds it.
    """
    used = rules.filter(F.col("ua_token").isNotNull() & F.col("kind").isin("allow", "disallow"))
    ends = F.col("pattern").endswith("$")
    body = F.when(ends, F.substr("pattern", F.lit(1), F.length("pattern") - 1)).otherwise(F.col("pattern"))
    pieces = F.split(octets(F.regexp_replace(body, r"\*+", "*")), r"\*")
    r = used.select("site", "ua_token", (F.col("kind") == "allow").cast("int").alias("allow"), F.length("pattern").alias("len"), ends.alias("ends"), pieces.alias("pieces"))
    rule = F.struct("len", "allow", F.slice("pieces", F.lit(2), F.size("pieces")).alias("pieces"), "ends")
    return r.groupBy("site", "ua_token", F.get("pieces", F.lit(0)).alias("prefix")).agg(F.collect_list(rule).alias("filed"))


def glob_matches(path: Column, after: Column, pieces: Column, ends: Column) -> Column:
    """Whether the path goes on, behind its first `after` characters, with the pieces in order and anything before each.

    Every piece is taken where it first occurs, so nothing is tried twice: the time is that of one search for each piece.
    With `ends` the last piece must end the path, and without pieces the path must end there.
    """
    last = F.element_at(pieces, -1)
    inner = F.when(ends & (F.size(pieces) > 0), F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    step = lambda at, piece: F.when((at == 0) | (piece == ""), at).otherwise(let(F.call_function("locate", piece, path, at), lambda found: F.when(found == 0, 0).otherwise(found + F.length(piece))))
    at = F.aggregate(inner, after + 1, step)
    closed = F.when(F.size(pieces) == 0, F.length(path) == after).otherwise(path.endswith(last) & (F.length(path) - F.length(last) + 1 >= at))
    return (at > 0) & (~ends | closed)


def _decide(asked: DataFrame, rules: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """asked has site, keys, agent (lower case) and path; adds allowed.

    The agent's own groups decide if the site has any, else those of '*'. The longest matching pattern wins, an allow
    among equals; no match, or no robots file, is allowed; an unavailable file denies everything.

    A path asks for its prefixes of the lengths that its group's rules have, and meets the rules filed under them: no row
    is made for a rule whose literal beginning the path has not.
    """
    used = rules.filter("ua_token is not null")
    mine = used.filter("kind = 'agent'").select("site", F.col("ua_token").alias("agent")).distinct().withColumn("named", F.lit(True))
    a = asked.join(states.select("site", "state"), "site", "left").join(mine, ["site", "agent"], "left")
    a = a.withColumn("ua_token", F.when(F.col("named"), F.col("agent")).otherwise("*"))
    filed = cut(filed_rules(rules), "robots-filed")
    lengths = filed.groupBy("site", "ua_token").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    a = a.join(lengths, ["site", "ua_token"], "left").withColumn("after", F.explode_outer(F.filter("lengths", lambda n: n <= F.length("path"))))
    j = a.withColumn("prefix", F.substr("path", F.lit(1), F.col("after"))).join(filed, ["site", "ua_token", "prefix"], "left")
    met = F.filter("filed", lambda r: glob_matches(F.col("path"), F.col("after"), r["pieces"], r["ends"]))
    j = j.select("site", *keys, "state", F.array_max(F.transform(met, lambda r: F.struct(r["len"].alias("len"), r["allow"].alias("allow")))).alias("best"))
    best = j.groupBy("site", *keys, "state").agg((F.max("best")["allow"] == 1).alias("allow"))
    allowed = F.when(F.col("state") == "found", F.coalesce("allow", F.lit(True))).when(F.col("state") == "absent", True).otherwise(False)
    return best.withColumn("allowed", allowed).drop("allow")


def url_allowed(urls: DataFrame, rules: DataFrame, states: DataFrame, ua: str) -> DataFrame:
    """(site, url) to (site, url, state, allowed)."""
    path = F.regexp_replace(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), "#.*$", "")
    return _decide(urls.select("site", "url", F.lit(ua.lower()).alias("agent"), octets(path).alias("path")).distinct(), rules, states, ["url"])


def ai_bot_access(states: DataFrame, rules: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each catalog agent at the root of each site whose robots state is known."""
    known = states.filter("state <> 'unavailable'").select("site", "state")
    # The catalog is a fixed list of 11 rows.
    asked = known.select("site").crossJoin(F.broadcast(catalog)).select("site", "ord", "token", "vendor", "purpose", F.lower("token").alias("agent"), F.lit("/").alias("path"))
    done = _decide(asked, rules, known, ["ord", "token", "vendor", "purpose"])
    return done.select("site", "ord", "token", "vendor", "purpose", "allowed", (F.col("state") == "found").alias("robots_found"))


def policy_summary(access: DataFrame) -> DataFrame:
    """One text for each site: blocked and allowed agents by purpose, agents in catalog order."""
    names = lambda yes: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("allowed") == yes, F.struct("ord", "token")))), lambda x: x["token"]), ", ")
    by = access.groupBy("site", "purpose", "robots_found").agg(names(False).alias("blocked"), names(True).alias("allowed_names"))
    by = by.withColumn("rank", F.array_position(F.array(*map(F.lit, PURPOSES)), F.col("purpose")))
    text = F.concat_ws(" / ", F.when(F.col("blocked") != "", F.concat(F.lit("blocked: "), F.col("blocked"))), F.when(F.col("allowed_names") != "", F.concat(F.lit("allowed: "), F.col("allowed_names"))))
    rows = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.col("purpose"), F.lit(" - "), text).alias("line"))))
    return by.groupBy("site", "robots_found").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "; ").alias("summary"))


def robots_sitemaps(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """Sitemap candidates: those that robots.txt declares, else /sitemap.xml of the site."""
    declared = rules.filter("kind = 'sitemap' and pattern <> ''").groupBy("site").agg(F.array_sort(F.collect_list(F.struct("ord", "pattern"))).alias("m"))
    j = sites.select("site").distinct().join(declared, "site", "left")
    urls = F.coalesce(F.transform("m", lambda x: x["pattern"]), F.array(F.concat("site", F.lit("/sitemap.xml"))))
    return j.select("site", F.posexplode(urls).alias("ord", "sitemap_url"))


def same_origin_seeds(urls: DataFrame) -> DataFrame:
    """Sitemap URLs that may seed a crawl at depth 1: of the site's own origin, in the order that they are listed.

    urls: site, root (the sitemap they come from), ord, url. A URL that does not parse ends its sitemap: it and what
    follows are no seeds.
    """
    origin = url_origin(F.col("url"))
    ends = urls.filter(origin.isNull()).groupBy("site", "root").agg(F.min("ord").alias("__end"))
    j = urls.filter(origin == F.col("site")).join(ends, ["site", "root"], "left")
    return j.filter(F.col("__end").isNull() | (F.col("ord") < F.col("__end"))).drop("__end").withColumn("depth", F.lit(1))
