"""Connectors that replay what was recorded: result pages of search providers, fetched documents, sitemaps, probes of domains, JSON traces.

Nothing reaches the network: a recording is a table, so a run can be repeated and its plan be pushed down to the files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import parse_qs, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..functions import identity as I
from ..functions import url as U
from .html import parse
from .tables import cut

#: Where a provider's pages have results: class (or tag) of a result's link and of its snippet, and the parameter of redirects.
PROVIDERS = {
    "bing": (r"\bb_algo\b", r"\bb_caption\b|\bb_lineclamp", ("u",)),
    "google": (r"\byuRUbf\b|\bg\b", r"\bVwiC3b\b", ("q", "url")),
    "duckduckgo_html": (r"\bresult__a\b", r"\bresult__snippet\b", ("uddg",)),
    "duckduckgo_lite": (r"\bresult-link\b", r"\bresult-snippet\b", ("uddg",)),
    "naver": (r"\blink_tit\b|\btitle_link\b", r"\bapi_txt_lines\b|\bdsc_txt\b", ("url",)),
    "seznam": (r"\be_\w+\b.*\btitle|\bResult-title", r"\bResult-description|description\b", ()),
}
BLOCKED = re.compile(r"captcha|verify you are a human|unusual traffic|비정상적인 접근|anomaly-modal", re.I)


def result_links(provider: str, html: str) -> list[tuple[str, str, str]]:
    """(url, title, snippet) of the organic results of a recorded page, redirects undone, in order; the provider's own links are left out."""
    link, snippet, parameters = PROVIDERS.get(provider, (r".", r"^$", ()))
    out: list[list[str]] = []
    for node in parse(html).walk():
        marks = node.attrs.get("class", "")
        if re.search(snippet, marks) and out and not out[-1][2]:
            out[-1][2] = node.text()
        anchor = node if node.tag == "a" and re.search(link, marks) else next((n for n in node.walk() if n.tag == "a"), None) if node.tag in ("li", "div", "h3") and re.search(link, marks) else None
        if anchor is None or not anchor.attrs.get("href"):
            continue
        url = anchor.attrs["href"]
        asked = parse_qs(urlparse(url).query)
        url = next((asked[p][0] for p in parameters if asked.get(p) and asked[p][0].startswith("http")), "https:" + url if url.startswith("//") else url)
        host = urlparse(url).hostname or ""
        if url.startswith("http") and not re.search(provider.split("_")[0] + r"\.", host) and all(o[0] != url for o in out):
            out.append([url, anchor.text(), ""])
    return [tuple(o) for o in out]


class RecordedSearch(DataSource):
    """Format recorded_search: a folder of JSON lines {provider, query, html}, a partition for each file; rows provider, query, rank, url, title, snippet, status."""

    @classmethod
    def name(cls) -> str:
        return "recorded_search"

    def schema(self) -> str:
        return "provider string, query string, rank int, url string, title string, snippet string, status string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _SearchReader(self.options["path"])


class _File(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _SearchReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _fs(self):  # noqa: ANN202
        import pyarrow.fs as fs

        return fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[_File]:
        import pyarrow.fs as fs

        system, root = self._fs()
        return [_File(i.path) for i in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda i: i.path) if i.base_name.endswith(".jsonl")]

    def read(self, part: _File | None) -> Iterator[tuple]:
        if part is None:  # there are no files
            return
        with self._fs()[0].open_input_stream(part.name) as f:
            for line in f.read().decode("utf-8").splitlines():
                page = json.loads(line)
                yield from page_results(page["provider"], page["query"], page.get("html"))


def page_results(provider: str, query: str, html: str | None) -> list[tuple]:
    """Rows of one recorded page: its results, or one row without a URL that tells why there are none."""
    found = result_links(provider, html or "")
    if found:
        return [(provider, query, k, *r, "success") for k, r in enumerate(found, 1)]
    status = "blocked" if BLOCKED.search(html or "") else "parse_error" if "<a " in (html or "") else "empty"
    return [(provider, query, 0, None, None, None, status)]


def search_pages(pages: DataFrame) -> DataFrame:
    """provider, query, rank, url, title, snippet, status of recorded result pages (provider, query, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, q, h in pdf.itertuples(index=False) for r in page_results(p, q, h)]
            yield pd.DataFrame(rows, columns=["provider", "query", "rank", "url", "title", "snippet", "status"])

    return pages.select("provider", "query", "html").mapInPandas(run, "provider string, query string, rank int, url string, title string, snippet string, status string")


def provider_chain(results: DataFrame, order: list[str], enough: int) -> DataFrame:
    """Of each query the rows of the providers that were asked: in order, until one that gives `enough` results; what comes after it was never asked."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("provider"))
    n = results.filter("status = 'success'").groupBy("query", "provider").agg(F.count("*").alias("n"))
    stop = n.filter(F.col("n") >= enough).groupBy("query").agg(F.min(place).alias("stop"))
    return results.filter(place > 0).join(stop, "query", "left").filter(place <= F.coalesce("stop", F.lit(len(order)))).drop("stop")


# ---------------------------------------------------------------- fetched documents
def fetch_recorded(wanted: DataFrame, fetched: DataFrame) -> DataFrame:
    """wanted (url, ...) with what was recorded for the URL, else for it with or without a final slash: final_url, http_status, content_type, content, status.

    A URL that is none, or that was never recorded, has a status that says so."""
    r = fetched.groupBy("source_url").agg(F.max_by(F.struct("final_url", "http_status", "content_type", "content"), F.struct((F.col("http_status") == 200).alias("ok"), F.col("http_status"))).alias("r"))
    other = F.when(F.col("url").endswith("/"), F.regexp_replace("url", "/$", "")).otherwise(F.concat("url", F.lit("/")))
    rows = wanted.withColumn("_other", other)
    rows = rows.join(r.select(F.col("source_url").alias("url"), F.col("r").alias("_a")), "url", "left").join(r.select(F.col("source_url").alias("_other"), F.col("r").alias("_b")), "_other", "left")
    r1 = F.when(F.col("_a.http_status") == 200, F.col("_a")).otherwise(F.coalesce(F.when(F.col("_b.http_status") == 200, F.col("_b")), F.col("_a"), F.col("_b")))
    rows = rows.withColumn("_r", r1)
    code = F.col("_r.http_status")
    status = (
        F.when(U.canonical_url(F.coalesce("url", F.lit(""))) == "", "unsupported").when(F.col("_r").isNull(), "not_recorded").when(code == 404, "not_found").when(code.isin(401, 403), "blocked").when(code == 429, "rate_limited")
        .when(code >= 500, "unavailable").when(code >= 400, "error").when(F.coalesce("_r.content", F.lit("")) == "", "empty").otherwise("success")
    )
    return rows.select(*wanted.columns, "_r.*", status.alias("status"))


def sitemap_urls(recorded: DataFrame, roots: DataFrame, depth: int = 4) -> DataFrame:
    """domain, url, level of the page URLs that recorded sitemaps (url, text) under roots (domain, url) list, sitemaps of sitemaps followed to `depth`.

    Each level is one join of the frontier with the recording; a sitemap met before is not taken up again, so cycles end."""
    text = recorded.select(U.canonical_url(F.col("url")).alias("_map"), F.col("text").alias("_text"))
    frontier = roots.select("domain", U.canonical_url(F.col("url")).alias("map")).filter("map <> ''").distinct()
    seen, pages = frontier, None
    for level in range(depth + 1):
        each = frontier.join(text, F.col("map") == F.col("_map")).select("domain", F.explode(F.regexp_extract_all("_text", F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), 1)).alias("loc"))
        each = each.select("domain", F.regexp_replace(F.replace("loc", F.lit("&amp;"), F.lit("&")), r"\s", "").alias("loc")).distinct()
        is_map = F.lower("url").rlike(r"\.xml(?:\.gz)?$")
        each = cut(each.select("domain", U.canonical_url(F.col("loc")).alias("url"))).filter((F.col("url") != "") & U.belongs(F.col("url"), F.col("domain")))
        own = each.filter(~is_map).withColumn("level", F.lit(level))
        pages = own if pages is None else pages.unionByName(own)
        frontier = cut(each.filter(is_map).select("domain", F.col("url").alias("map")).join(seen, ["domain", "map"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return pages.groupBy("domain", "url").agg(F.min("level").alias("level"))


#: Stages of a probe, in the order in which they are tried.
STAGES = ("links", "site_search", "sku_template", "sitemap", "sku_route", "crawl", "second_hop")


def probe_records(found: DataFrame, model: Column) -> DataFrame:
    """Of each domain the records (domain, stage, url, title) up to the first stage that has an exact one; homepages, catalogues and search pages are none. The
    first stage of equal URLs counts."""
    rows = found.withColumn("place", F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))).filter("place > 0")
    rows = rows.withColumn("canonical", U.canonical_url(F.col("url"))).filter((F.col("canonical") != "") & U.belongs(F.col("url"), F.col("domain")) & ~U.page_kind(F.col("url")).isin("homepage", "catalog"))
    rows = rows.withColumn("match", I.candidate_match(model, F.col("title"), F.col("url")))
    stop = F.min(F.when(F.col("match") == "exact", F.col("place"))).over(Window.partitionBy("domain"))
    rows = rows.withColumn("_stop", F.coalesce(stop, F.lit(len(STAGES)))).filter("place <= _stop")
    return rows.groupBy("domain", "canonical").agg(F.min_by(F.struct("stage", "match"), "place").alias("r")).select("domain", F.col("canonical").alias("url"), "r.stage", "r.match")


def template_urls(prefixes: DataFrame, skus: DataFrame) -> DataFrame:
    """domain, url of what a domain's learned path prefixes (domain, prefix, n) make of the stock numbers asked of it (domain, sku): an equi-join on the domain."""
    return prefixes.join(skus, "domain").select("domain", F.concat(F.lit("https://"), "domain", "prefix", F.lower("sku")).alias("url")).distinct()


def document_urls(pages: DataFrame) -> DataFrame:
    """page_id, url of the files of documents in scripts and attributes of pages (page_id, html), escapes of JSON undone; each once a page."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"\\/", "/")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"""(?i)((?:https?:)?//[^\s"'<>()\[\]{}|^`\\]+\.(?:pdf|docx?)(?:\?[^\s"'<>()\[\]{}|^`\\]*)?)"""), 1))
    return pages.select("page_id", F.explode(found).alias("u")).select("page_id", F.when(F.col("u").startswith("//"), F.concat(F.lit("https:"), "u")).otherwise(F.col("u")).alias("url")).distinct()


def resolved_links(links: DataFrame) -> DataFrame:
    """links (page_url, href, ...) with url: absolute, by the rules of URLs; null for what is no link to a page."""

    @F.pandas_udf("string")
    def absolute(base: pd.Series, href: pd.Series) -> pd.Series:
        out = []
        for b, h in zip(base, href, strict=True):
            try:
                u = urljoin(b or "", h or "") if h and not re.match(r"#|javascript:|mailto:|tel:", h, re.I) else None
            except ValueError:
                u = None
            out.append(u if u and u.startswith("http") else None)
        return pd.Series(out, index=base.index, dtype=object)

    return links.withColumn("url", absolute("page_url", "href"))


def official_spec_links(links: DataFrame, limit: int) -> DataFrame:
    """entity, url, place of links (entity, seq, page_url, url, anchor) that lead to technical pages of the same domain; limit an entity."""
    hint = F.lower(F.concat_ws(" ", "anchor", U.path(F.col("url")))).rlike(r"tech[\s_-]*spec|specification|technical|datasheet|характеристик|/specs?(?:/|$)")
    same = U.registrable_domain(U.host(F.col("url"))) == U.registrable_domain(U.host(F.col("page_url")))
    first = links.filter(hint & same & (U.canonical_url(F.col("url")) != U.canonical_url(F.col("page_url")))).groupBy("entity", U.canonical_url(F.col("url")).alias("url")).agg(F.min("seq").alias("seq"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy("seq"))).filter(F.col("place") <= limit).select("entity", "url", "place")


# ---------------------------------------------------------------- JSON traces
ATTRIBUTE = "raw_label string, raw_value string, source_url string, source_type string, location string, method string, section string, document_type string, page_ref string, sku_scope string, seen_in array<string>"


def trace_attributes(traces: DataFrame) -> DataFrame:
    """entity, seq, raw_label, raw_value, ... of traces (entity, payload: JSON text with attributes); a payload that is no JSON, or has none, gives no rows."""
    parsed = traces.select("entity", F.from_json("payload", f"attributes array<struct<{ATTRIBUTE.replace(' ', ':').replace(',:', ',')}>>").alias("p"))
    return parsed.select("entity", F.posexplode("p.attributes").alias("seq", "a")).select("entity", "seq", "a.*")


def baseline_rows(spark: SparkSession, path: str) -> DataFrame:
    """product, confirmed, coverage of a JSON file of a baseline run; no file gives no rows."""
    kind = "products array<struct<id:string,confirmed:int,coverage:double>>"
    try:
        whole = spark.read.schema(kind).option("multiLine", True).json(path)
    except Exception as e:  # the reader's own message names the path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        whole = spark.createDataFrame([], kind)
    return whole.select(F.explode("products").alias("p")).select(F.col("p.id").alias("product"), "p.confirmed", "p.coverage")
