"""Registered queries over the test tables: each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions import codecs, params, sql, urls
from ..functions.predicates import PREDICATES
from ..functions.types import OFFSETS, PARTS, PATTERN_INIT
from ..operators import patterns as P
from ..operators import relational as R
from ..operators.router import route
from ..sources.lines import dump_lines, invalid_lines, part_lines, read_lines, throughput, write_lines
from ..streaming import urls as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows over all cores: a table of short rows may be a single row group, which one task reads however many rows it has."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query
def host_counts(spark, sf_dir):
    return R.host_counts(pages(spark, sf_dir), "url")


@query
def url_components(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", *[urls.url_part("url", p).alias(p) for p in PARTS])


@query
def url_struct(spark, sf_dir):
    u = pages(spark, sf_dir).select("page_id", urls.url_parse("url").alias("u"))
    return u.select("page_id", "u.href", "u.scheme_type", "u.host_type", "u.has_opaque_path", "u.raw_host", "u.raw_query", "u.raw_fragment")


@query
def url_offsets(spark, sf_dir):
    u = pages(spark, sf_dir).select("page_id", urls.url_parse("url").alias("u"))
    # a missing part is at -1 here
    return u.select("page_id", *[F.coalesce(F.col(f"u.components.{n}"), F.lit(-1)).alias(f"at_{n}") for n in OFFSETS], urls.offsets_consistent(F.col("u")).alias("consistent"))


@query
def url_predicates(spark, sf_dir):
    u = pages(spark, sf_dir).select("page_id", urls.url_parse("url").alias("u"))
    tests = {"special": urls.is_special, "credentials": urls.has_credentials, "hostname": urls.has_hostname, "empty_hostname": urls.has_empty_hostname, "has_port": urls.has_port, "has_search": urls.has_search, "has_hash": urls.has_hash, "size": urls.href_size, "path_size": urls.pathname_length}
    return u.select("page_id", *[f(F.col("u")).alias(n) for n, f in tests.items()], urls.default_port(F.col("u.protocol")).alias("port_by_default"), urls.dns_length_ok(F.col("u.hostname")).alias("dns_ok"))


def order_texts(spark, sf_dir) -> DataFrame:
    """A column t of valid and invalid URLs, by the order key."""
    k = F.col("o_orderkey")
    kinds = [text("https://h", k, ".example/", k), F.lit("http://"), text("//h", k, "/x"), text("mailto:u", k, "@example.com"), text("http://exa mple", k, "/"), text("http://1.2.3.", k % 300), text("http://h:", k), text("x", k)]
    t = F.lit(None).cast("string")
    for i, c in enumerate(kinds):
        t = F.when(k % len(kinds) == i, c).otherwise(t)
    return table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"))


@query
def can_parse_filter(spark, sf_dir):
    rows = order_texts(spark, sf_dir).withColumn("valid", urls.url_can_parse("t"))
    return rows.groupBy((F.col("o_orderkey") % 8).alias("kind"), "valid").agg(F.count("*").alias("n"))


@query
def can_parse_with_base(spark, sf_dir):
    rows = order_texts(spark, sf_dir).withColumn("valid", urls.url_can_parse("t", F.lit("https://base.example/a/b")))
    return rows.groupBy((F.col("o_orderkey") % 8).alias("kind"), "valid").agg(F.count("*").alias("n"))


@query
def invalid_urls(spark, sf_dir):
    return R.invalid_rows(order_texts(spark, sf_dir), "t")


@query
def normalize_mixed(spark, sf_dir):
    k = F.col("c_custkey")
    t = text("  HTTP://Us er:P@w@Shop", k % 50, ".Example.COM:80/a/./b/../c\\", k, "/%2E%2e/é?q=a b'#x y`  ")
    return spread(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", urls.url_part(t, "href").alias("href"))


@query
def resolve_links(spark, sf_dir):
    found = R.links(table(spark, sf_dir, "pages"), "url", "html")
    return found.select("page_id", "position", "link", "href")


@query
def resolve_references(spark, sf_dir):
    """Relative references of each kind against each page."""
    refs = ["../up", "?only=query", "#only-fragment", "//other.example/p", "./a/../b", "sub/./x", "", "ftp://f.example"]
    rows = pages(spark, sf_dir).select("page_id", "url", F.posexplode(F.array(*map(F.lit, refs))).alias("kind", "ref"))
    return rows.select("page_id", "kind", urls.url_resolve("ref", "url").getField("href").alias("href"))


@query
def params_explode(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", urls.url_part("url", "search").alias("search"))
    return params.params_explode(rows, "search").drop("search")


def order_params(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    q = text("?b=", k % 7, "&a=x+y&c&a=%41", k, "&=e&z=%zz")
    return table(spark, sf_dir, "orders").select("o_orderkey", params.params_parse(q).alias("p"))


@query
def params_read(spark, sf_dir):
    p = F.col("p")
    return order_params(spark, sf_dir).select(
        "o_orderkey",
        params.params_size(p).alias("n"),
        params.params_get(p, "a").alias("first_a"),
        params.params_get(p, "none").alias("missing"),
        F.array_join(params.params_get_all(p, "a"), "|").alias("all_a"),
        params.params_has(p, "c").alias("has_c"),
        params.params_has(p, "b", "3").alias("has_b3"),
        F.array_join(params.params_keys(p), "|").alias("keys"),
        F.array_join(params.params_values(p), "|").alias("vals"),
    )


@query
def params_edit(spark, sf_dir):
    p = F.col("p")
    show = params.params_text
    return order_params(spark, sf_dir).select(
        "o_orderkey",
        show(p).alias("written"),
        show(params.params_set(p, "a", "new value")).alias("set_a"),
        show(params.params_set(p, "y", "1")).alias("set_y"),
        show(params.params_append(p, "b", "é")).alias("appended"),
        show(params.params_remove(p, "a")).alias("removed"),
        show(params.params_remove(p, "a", "x y")).alias("removed_one"),
        show(params.params_sort(p)).alias("ordered"),
    )


@query
def strip_tracking(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", R.without_tracking("url").alias("href"))


@query
def canonical_dedup(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", text("https://h", F.col("user_id") % 10, ".example/p/", e % 50, "#f", e).alias("url"))
    return R.canonical_dedup(rows, "url", ["event_id"]).select("canonical", "n_copies", "event_id")


@query
def host_top(spark, sf_dir):
    return R.ranked_by_host(pages(spark, sf_dir), "url", ["page_id"], 2).select("hostname", "page_id", "rank")


@query
def scheme_host_rollup(spark, sf_dir):
    return R.host_rollup(pages(spark, sf_dir), "url")


def blocked(spark, sf_dir) -> DataFrame:
    return pages(spark, sf_dir).select(urls.url_part("url", "hostname").alias("hostname")).where(F.col("hostname").rlike("spam|adult|pills"))


@query
def hosts_allowed(spark, sf_dir):
    return R.without_hosts(pages(spark, sf_dir), "url", blocked(spark, sf_dir))


@query
def hosts_blocked(spark, sf_dir):
    return R.only_hosts(pages(spark, sf_dir), "url", blocked(spark, sf_dir))


@query
def href_set_operations(spark, sf_dir):
    """Hostnames of plain and of secure pages: on both sides, or on one only."""
    rows = pages(spark, sf_dir).select(urls.url_part("url", "protocol").alias("protocol"), urls.url_part("url", "hostname").alias("hostname"))
    a, b = (rows.where(F.col("protocol") == p).select("hostname") for p in ("http:", "https:"))
    both = a.intersect(b)
    sides = {"both": both, "plain": a.exceptAll(b).distinct().exceptAll(both), "secure": b.subtract(a), "any": a.union(b).distinct()}
    out = None
    for side, hosts in sides.items():
        hosts = hosts.withColumn("side", F.lit(side))
        out = hosts if out is None else out.unionByName(hosts)
    return out


LANGUAGE = {"protocol": "http{s}?", "hostname": "*.example.:tld", "pathname": "/:lang(en|de)/*"}


@query
def pattern_test(spark, sf_dir):
    p = P.url_pattern(LANGUAGE)
    return pages(spark, sf_dir).select("page_id", P.url_pattern_test(p, "url").alias("matches"))


@query
def pattern_exec(spark, sf_dir):
    p = P.url_pattern("http{s}?://:sub.*/:lang/:id(\\d+){.html}?{/}?\\?*")
    m = pages(spark, sf_dir).select("page_id", P.url_pattern_exec(p, "url").alias("m")).where("m IS NOT NULL")
    return m.select("page_id", F.col("m.hostname.groups")["sub"].alias("sub"), F.col("m.pathname.groups")["lang"].alias("lang"), F.col("m.pathname.groups")["id"].alias("id"), F.col("m.search.input").alias("search"))


@query
def pattern_router(spark, sf_dir):
    rules = [
        ("english", P.url_pattern({"pathname": "/en/*"})),
        ("secure", P.url_pattern("https://*/*")),
        ("feed", P.url_pattern({"search": "utm_source=:s"})),
        ("top", P.url_pattern({"hash": "TOP"}, ignore_case=True)),
        ("spam", P.url_pattern("https://spam-farm.example.org/*")),
        ("pills", P.url_pattern("https://www.cheap-pills.example.com/:lang/*")),
    ]
    return route(pages(spark, sf_dir), "url", rules).select("page_id", "pattern_id")


@query
def set_parts(spark, sf_dir):
    changes = {"port": "8080", "host": "New.Example:99", "hostname": "ü.example", "protocol": "ftp", "username": "a b", "password": "p:w", "pathname": "x/../y z", "search": "q=1 2", "hash": "a b"}
    return pages(spark, sf_dir).select("page_id", *[urls.url_with("url", part, value).alias(f"with_{part}") for part, value in changes.items()])


@query
def set_refused(spark, sf_dir):
    """Values that setters refuse leave the URL and say so."""
    refused = {"port": "x", "hostname": "a:1", "protocol": "mailto", "host": "", "href": "nothing"}
    sets = {part: urls.url_set("url", part, value) for part, value in refused.items()}
    return pages(spark, sf_dir).select("page_id", *[s.getField("ok").alias(f"ok_{p}") for p, s in sets.items()], *[s.getField("url").getField("href").alias(f"href_{p}") for p, s in sets.items()])


@query
def clear_parts(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", *[urls.url_clear("url", p).getField("href").alias(f"no_{p}") for p in ("port", "search", "hash")], urls.url_without_hash("url").alias("without_hash"))


@query
def percent_codecs(spark, sf_dir):
    t = text(F.col("n_name"), " a/b?c=d&e~*'\"<>`{}|^é%41%zz+")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", t.alias("t"))
    sets = ("c0_control", "fragment", "query", "special_query", "path", "userinfo", "www_form")
    return rows.select("n_nationkey", *[codecs.percent_encode("t", s).alias(s) for s in sets], codecs.percent_decode("t").alias("decoded"), codecs.form_encode("t").alias("form"), codecs.form_decode("t").alias("from_form"))


@query
def ipv4_normalize(spark, sf_dir):
    """Addresses as one decimal, hexadecimal or octal number, and in two parts."""
    v = F.pmod(F.col("c_custkey") * 2654435761, F.lit(2**32)).cast("long")
    rows = spread(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", v.alias("v"))
    shown = {"decimal": v.cast("string"), "hexadecimal": F.concat(F.lit("0x"), F.lower(F.hex("v"))), "octal": F.concat(F.lit("0"), F.conv(F.col("v").cast("string"), 10, 8)), "two_parts": F.concat_ws(".", F.shiftright("v", 24).cast("string"), F.pmod(F.col("v"), F.lit(2**24)).cast("string"))}
    shown["decimal"] = F.col("v").cast("string")
    return rows.select("c_custkey", *[urls.url_part(F.concat(F.lit("http://"), s, F.lit("/")), "hostname").alias(n) for n, s in shown.items()], codecs.ipv4_text("v").alias("direct"), codecs.ipv4_value(codecs.ipv4_text("v")).alias("back"))


@query
def ipv6_hosts(spark, sf_dir):
    k = F.col("s_suppkey")
    h = F.lower(F.hex(k))
    return spread(table(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", codecs.parse_host(text("[2001:DB8:0:0:", h, ":0:0:1]")).alias("short"), codecs.parse_host(text("[::ffff:1.2.3.", k % 256, "]")).alias("mapped"), codecs.parse_host(text("[1:2:3:", h, "::5::6]")).alias("wrong"))


DOMAINS = ["Bücher.Example", "faß.de", "xn--mnchen-3ya.de", "日本語。jp", "EXAMPLE.com", "ab­c.de", "a≠b.com", "̀a.de", "xn--a", "%41.com"]


@query
def idna_domains(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.posexplode(F.array(*map(F.lit, DOMAINS))).alias("i", "domain"))
    ascii_ = codecs.domain_to_ascii("domain")
    return rows.select("r_regionkey", "i", "domain", ascii_.alias("ascii"), codecs.domain_to_unicode(ascii_).alias("readable"))


@query
def dns_lengths(spark, sf_dir):
    k = F.col("p_partkey")
    host = F.concat(F.repeat(F.lit("a"), (k % 70).cast("int")), F.lit("."), F.array_join(F.array_repeat(F.repeat(F.lit("b"), 60), (k % 6).cast("int")), "."), F.lit(".com"), F.when(k % 2 == 0, ".").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", urls.dns_length_ok(host).alias("ok"))


@query
def file_urls(spark, sf_dir):
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", codecs.url_from_file(text("/data/./", F.col("p_name"), "/../", F.col("p_brand"), "\\x?", F.col("p_partkey"), "#")).alias("href"))


@query
def opaque_urls(spark, sf_dir):
    t = text("data:text/plain, ", F.col("c_mktsegment"), "  ?q#", F.col("c_custkey"))
    return spread(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", urls.url_part(t, "href").alias("href"), urls.url_part(t, "pathname").alias("pathname"), urls.url_part(t, "origin").alias("origin"), urls.url_part(t, "has_opaque_path").alias("opaque"))


@query
def length_limit(spark, sf_dir):
    """URLs that are longer than a limit, as written or normalized, are invalid."""
    return pages(spark, sf_dir).select("page_id", urls.url_can_parse("url", max_length=40).alias("fits"), urls.url_parse("url", max_length=40).getField("href").alias("href"))


@query
def line_parts(spark, sf_dir):
    return part_lines(order_texts(spark, sf_dir), "host", "t").groupBy("value").agg(F.count("*").alias("n"))


@query
def sql_functions(spark, sf_dir):
    sql.register(spark)
    pages(spark, sf_dir).createOrReplaceTempView("urlloom_pages")
    return spark.sql(
        "SELECT page_id, url_hostname(url) AS hostname, url_can_parse(url) AS valid, url_get_pathname(url) AS pathname, params_get(params_parse(url_get_search(url)), 'ref') AS ref,"
        " (SELECT count(*) FROM url_params('a=1&b=2')) AS n_fixed FROM urlloom_pages"
    )


@query
def window_hosts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("ts", text("https://h", F.col("user_id") % 5, ".example/").alias("url"))
    hosts = rows.select("ts", urls.url_part("url", "hostname").alias("hostname"))
    return hosts.groupBy(F.window("ts", "1 day"), "hostname").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "hostname", "n")


@query
def stream_hosts(spark, sf_dir):
    """Pages as a stream, parsed and written by a streaming query that ends with its input, then counted."""
    from .scratch import fresh

    source = spark.readStream.schema("page_id long, url string, html string").option("pathGlobFilter", "*.parquet")
    rows = source.parquet(f"{sf_dir}/pages.parquet*").select("page_id", urls.url_part("url", "hostname").alias("hostname"))
    out, state = fresh(spark, "hosts"), fresh(spark, "state")
    rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("page_id long, hostname string").parquet(out).groupBy("hostname").agg(F.count("*").alias("n"))


@query
def stream_windows(spark, sf_dir):
    """Hourly counts by host of a stream of events with a watermark; open windows at the end are not given out."""
    from .scratch import fresh

    source = spark.readStream.schema("event_id long, ts timestamp, user_id long").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    rows = source.select("ts", text("https://h", F.col("user_id") % 5, ".example/").alias("url"))
    counts = stream.host_windows(rows, "url", "ts", "1 hour", "0 seconds")
    out, state = fresh(spark, "windows"), fresh(spark, "state")
    counts.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("start timestamp, end timestamp, hostname string, n long").parquet(out).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "hostname", "n")


@query
def approx_distinct_hosts(spark, sf_dir):
    """How many hostnames each protocol has, and whether the sketch is near that."""
    rows = pages(spark, sf_dir).select(urls.url_part("url", "protocol").alias("protocol"), urls.url_part("url", "hostname").alias("hostname"))
    counts = rows.groupBy("protocol").agg(F.countDistinct("hostname").alias("n"), F.approx_count_distinct("hostname", 0.02).alias("about"))
    return counts.select("protocol", "n", (F.abs(F.col("about") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


@query
def dump_and_diagram(spark, sf_dir):
    u = pages(spark, sf_dir).select("page_id", urls.url_parse("url").alias("u"))
    return u.select("page_id", urls.url_dump(F.col("u")).alias("dump"), urls.url_diagram(F.col("u")).alias("diagram"))


@query
def files_of_lines(spark, sf_dir):
    """Lines written as files, read from there, and their hosts written to files and read again."""
    from .scratch import fresh

    lines, out = fresh(spark, "lines"), fresh(spark, "values")
    write_lines(order_texts(spark, sf_dir).select(F.col("t").alias("value")), lines)
    write_lines(part_lines(read_lines(spark, lines), "host"), out)
    return spark.read.text(out).groupBy("value").agg(F.count("*").alias("n"))


@query
def invalid_lines_report(spark, sf_dir):
    """What validation of all lines reports, beside the lines that it refuses."""
    lines = order_texts(spark, sf_dir).select(F.col("t").alias("url"))
    report = throughput(lines)
    return invalid_lines(lines).select("value", F.lit(report.bytes).alias("n_bytes"), F.lit(report.lines).alias("n_lines"), F.lit(report.invalid).alias("n_invalid"))


@query
def dumped_lines(spark, sf_dir):
    """Lines as JSON, signs escaped; the text is read back from it."""
    t = F.concat(F.lit("http://h/"), F.col("n_nationkey").cast("string"), F.lit("?a='{}&b=é\\"), F.lit("#<\"\t`"))
    rows = table(spark, sf_dir, "nation").select(t.alias("url"))
    values = dump_lines(rows)
    return values.select(F.get_json_object("value", "$.href").alias("href"), F.get_json_object("value", "$.hash").alias("hash"), F.contains("value", F.lit("\t")).alias("raw_tab"))


@query
def url_credentials(spark, sf_dir):
    k = F.col("c_custkey")
    who = F.when(k % 5 == 0, "").when(k % 5 == 1, "u@").when(k % 5 == 2, "u:p@").when(k % 5 == 3, ":p@").otherwise("@")
    u = spread(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", urls.url_parse(text("https://", who, "h", k, "/")).alias("u"))
    tests = {"any_of_them": urls.has_credentials, "name": urls.has_non_empty_username, "password": urls.has_non_empty_password, "with_password": urls.has_password}
    return u.select("c_custkey", F.col("u.href").alias("href"), *[f(F.col("u")).alias(n) for n, f in tests.items()])


@query
def opaque_edits(spark, sf_dir):
    """Blanks at the end of an opaque path when what follows it goes."""
    k = F.col("c_custkey")
    t = text("data:x", k, "  ", F.when(k % 2 == 0, "#f").otherwise("?q"))
    rows = spread(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", t.alias("t"))
    return rows.select("c_custkey", urls.url_part("t", "pathname").alias("pathname"), urls.url_clear("t", "hash").getField("href").alias("no_hash"), urls.url_clear("t", "search").getField("href").alias("no_search"), urls.url_with("t", "hash", "").alias("empty_hash"))


@query
def text_predicates(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.posexplode(F.array(*map(F.lit, PREDICATE_TEXTS))).alias("i", "t"))
    return rows.select("r_regionkey", "i", F.array_join(F.array(*[F.when(f("t"), F.lit("1")).otherwise("0") for f in PREDICATES.values()]), "").alias("holds"))


#: One text for each predicate at least.
PREDICATE_TEXTS = ["", "a\tb", "é", "a b", "a%b", "http", "9a", "123", "0xfF", "beef", "a.1", "1.2.3.4", "01.2.3.4", "1.2.3.256", ".", "%2E.", "C:", "c|", "a-b.c"]


@query
def pattern_components(spark, sf_dir):
    """A pattern over eight columns that need not come from one URL."""
    p = P.url_pattern(LANGUAGE)
    values = {n: urls.url_part("url", n) for n in ("username", "password", "hostname", "port", "pathname")}
    values |= {"protocol": F.lit("https"), "search": F.lit("x"), "hash": F.lit("")}
    return pages(spark, sf_dir).select("page_id", P.test_components(p, values).alias("matches"))


@query
def pattern_base(spark, sf_dir):
    """Patterns that inherit from a base: what lies beside the spam farm's pages, and below a folder of its."""
    beside = P.url_pattern({"pathname": "/en/*", "base_url": "https://spam-farm.example.org/x/y?z"})
    below = P.url_pattern("*", "https://spam-farm.example.org/en/y?z")
    return pages(spark, sf_dir).select("page_id", P.url_pattern_test(beside, "url").alias("beside"), P.url_pattern_test(below, "url").alias("below"))


PATTERNS = [
    "https://*.example.com/books/:id(\\d+)", {"pathname": "/a{/b}?/*"}, {"hostname": "{*.}?x.org", "port": "80"}, {"protocol": "http", "port": "80", "search": "q=:q"}, "http{s}?://h/p?:a=b#(x|y)+",
    {"pathname": "./c/:d", "base_url": "https://e.org/f/g"}, {"pathname": "/ü b", "hostname": "ü.de"},
]


@query
def pattern_getters(spark, sf_dir):
    """The normalized pattern of each component."""
    names = ("protocol", "username", "password", "hostname", "port", "pathname", "search", "hash")
    rows = [(i, *(getattr(p, n) for n in names), p.has_regexp_groups) for i, p in enumerate(map(P.url_pattern, PATTERNS))]
    return spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n in names) + ", groups boolean")


@query
def pattern_structured(spark, sf_dir):
    """Structured inputs, tested and matched."""
    k = F.col("o_orderkey")
    p = P.url_pattern({"hostname": "h:n(\\d+).example", "pathname": "/x/:rest*", "search": "*"})
    given = {"protocol": F.lit("https"), "hostname": text("h", k, F.when(k % 3 == 0, ".test").otherwise(".example")), "pathname": text("/x/", k, "/y z")}
    init = F.struct(*[given.get(f.name, F.lit(None).cast("string")).alias(f.name) for f in PATTERN_INIT.fields])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", init.alias("init"))
    found = P.url_pattern_exec_init(p, F.col("init"))
    return rows.select("o_orderkey", P.url_pattern_test_init(p, F.col("init")).alias("matches"), found["hostname"]["groups"]["n"].alias("n"), found["pathname"]["groups"]["rest"].alias("rest"))


@query
def library_version(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", F.lit(__version__).alias("version"))
