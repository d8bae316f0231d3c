"""URLs and product identifiers as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, second-level country domains, words of paths, domains by kind.
TRACKING = ("_ga", "_gl", "fbclid", "gad_source", "gclid", "igshid", "mc_cid", "mc_eid", "ref_", "srsltid", "yclid")
SECOND_LEVEL = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw")
GENERIC_SECOND = ("com", "co", "org", "net", "edu", "gov", "ac", "or", "ne")
WEAK_HINTS = (
    "compare", "comparison", "forum", "forums", "offersofproduct", "questions", "review", "reviews", "test", "testbericht", "tests", "threads",
    "preisvergleich", "toplist", "promotion", "promotions", "cashback", "coupon", "coupons", "rebate", "rebates", "terms", "conditions",
)
SUPPORT_HINTS = ("document", "documents", "download", "downloads", "manual", "manuals", "productservice", "service", "spec", "specification", "specifications", "support", "supportdetail")
CATALOG_SEGMENTS = ("catalog", "category", "categories", "collection", "collections", "products", "search", "shop", "tag", "tags")
PRODUCT_SEGMENTS = ("item", "p", "product", "products", "sku")
SEARCH_SEGMENTS = ("search", "suche", "recherche", "buscar")
SEARCH_KEYS = ("q", "query", "search", "searchterm", "keyword", "keywords")
BLOCKED_SEGMENTS = ("about", "account", "blog", "contact", "login", "news", "newsroom", "privacy", "register", "signin", "terms", "warranty")
BLOCKED_DOMAINS = ("facebook.com", "instagram.com", "linkedin.com", "pinterest.com", "tiktok.com", "twitter.com", "vk.com", "x.com", "youtube.com", "youtu.be")
MARKETPLACES = ("amazon", "aliexpress", "ebay", "ozon", "temu", "wildberries")
REFERENCES = ("gsmarena.com", "manua.ls", "manuals.co.uk", "manualslib.com", "manuals.plus", "manymanuals.com", "nanoreview.net")
FAMILY_LETTERS = ("FE", "SE", "XL", "XS", "XR", "LE", "GT", "GS", "OS", "HD", "UV", "TV")
RETAIL_WORDS = ("bestbuy", "citilink", "currys", "digitec", "dns-shop", "galaxus", "kaufland", "mediamarkt", "mvideo", "otto", "shop", "store", "retail", "technopark")


def strings(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def authority(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)


def host(url: Column) -> Column:
    """In lower case, without www. and port; an IPv6 address keeps its brackets."""
    return F.regexp_replace(F.lower(F.regexp_extract(authority(url), "^(\\[[^\\]]*\\]|[^:]*)", 1)), "^www\\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), "^[^?#]*\\?([^#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")


def query_keys(url: Column) -> Column:
    return F.transform(F.filter(F.split(query(url), "&"), lambda p: p.contains("=")), lambda p: F.substring_index(p, "=", 1))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no www, default port, doubled or final slash, fragment or tracking parameter; '' for
    what is no http(s) URL. Parameters keep their order and their escapes; one without a value keeps its equals sign."""
    return canonical(url, TRACKING, ("utm_",))


def canonical(url: Column, drop: tuple[str, ...], prefixes: tuple[str, ...], port: bool = True) -> Column:
    """canonical_url without the parameters named by drop or beginning with one of prefixes."""
    scheme = F.lower(F.regexp_extract(F.trim(url), "^([A-Za-z]+)://", 1))
    number = F.regexp_extract(authority(url), ":(\\d+)$", 1)
    clean = F.regexp_replace(path(url), "/{2,}", "/")
    clean = F.when(clean.isin("", "/"), "/").otherwise(F.regexp_replace(clean, "/$", ""))
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~key(p).rlike("^(?:" + "|".join(prefixes) + ")") & ~key(p).isin(*drop))
    q = F.array_join(F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))), "&")
    at = F.when(number.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), number)) if port else F.lit("")
    return F.when(
        scheme.isin("http", "https") & (host(url) != ""),
        F.concat(scheme, F.lit("://"), host(url), at, clean, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))),
    ).otherwise("")


def registrable_domain(domain: Column) -> Column:
    labels = F.split(F.regexp_replace(F.lower(domain), "^www\\.", ""), "\\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    second, top = F.element_at(labels, -2), F.element_at(labels, -1)
    three = last(2).isin(*SECOND_LEVEL) | ((F.length(top) == 2) & second.isin(*GENERIC_SECOND))
    return F.when(n < 2, labels[0]).when((n >= 3) & three, last(3)).otherwise(last(2))


def belongs(url: Column, domain: Column) -> Column:
    h, d = host(url), F.regexp_replace(F.lower(domain), "^www\\.", "")
    return (h != "") & (d != "") & ((h == d) | h.endswith(F.concat(F.lit("."), d)))


def _hinted(parts: Column, hints: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.flatten(F.transform(parts, lambda s: F.regexp_extract_all(s, F.lit("([a-z0-9]+)"), 1))), strings(hints))


def search_landing(url: Column) -> Column:
    parts = segments(url)
    return F.arrays_overlap(parts, strings(SEARCH_SEGMENTS)) | (F.arrays_overlap(query_keys(url), strings(SEARCH_KEYS)) & ~F.arrays_overlap(parts, strings(("product", "products", "p", "sku"))))


def page_kind(url: Column) -> Column:
    parts = segments(url)
    n = F.size(parts)
    return (
        F.when(search_landing(url), "catalog")
        .when((n == 0) | ((n == 1) & (F.length(F.get(parts, 0)) <= 3)), "homepage")
        .when(_hinted(parts, WEAK_HINTS), "weak")
        .when(_hinted(parts, SUPPORT_HINTS) | F.lower(path(url)).endswith(".pdf"), "support")
        .when(F.element_at(parts, -1).isin(*CATALOG_SEGMENTS) | F.array_contains(query_keys(url), "search"), "catalog")
        .when(F.arrays_overlap(parts, strings(PRODUCT_SEGMENTS)), "product")
        .otherwise("other")
    )


def not_a_product(url: Column) -> Column:
    root = registrable_domain(host(url))
    return (host(url) == "") | (host(url) == "google.com") | root.isin(*BLOCKED_DOMAINS) | F.arrays_overlap(segments(url), strings(BLOCKED_SEGMENTS))


def source_type(domain: Column, official: Column) -> Column:
    """Marketplaces first, whatever the official domain is."""
    return (
        F.when(F.substring_index(registrable_domain(domain), ".", 1).isin(*MARKETPLACES), "marketplace")
        .when(registrable_domain(domain).isin(*REFERENCES), "specialized_reference")
        .when((domain == official) | domain.endswith(F.concat(F.lit("."), official)), "manufacturer")
        .when(domain.rlike("|".join(w.replace("-", "[-]") for w in RETAIL_WORDS)), "retailer")
        .otherwise("other")
    )


def search_queries(brand: Column, model: Column, article: Column) -> Column:
    """Ordered distinct queries of what is known."""
    two, three = F.concat_ws(" ", brand, model), F.concat_ws(" ", brand, model, article)
    return F.array_distinct(F.filter(F.array(two, F.concat(F.lit('"'), two, F.lit('"')), three, article), lambda q: F.coalesce(q, F.lit("")) != ""))


# ---------------------------------------------------------------- identifiers
def compact(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def sku_token(model: Column) -> Column:
    """The longest token with letters and digits; the first of equals; null if there is none."""
    tokens = F.filter(F.split(model, "\\s+"), lambda t: t.rlike("[A-Za-z]") & t.rlike("[0-9]"))
    longest = F.array_max(F.transform(tokens, lambda t: F.length(compact(t))))
    return F.get(F.filter(tokens, lambda t: F.length(compact(t)) == longest), 0)


def suffix_kind(suffix: Column) -> Column:
    """regional: two characters that are no family name; variant: the rest."""
    return F.when(compact(suffix).rlike("^([A-Z]{2}|[A-Z][0-9]|[0-9][A-Z]|[0-9]{1,2})$") & ~compact(suffix).isin(*FAMILY_LETTERS), "regional").otherwise("variant")


def sku_relation(wanted: Column, text: Column) -> Column:
    """exact, same_base (what follows is a regional suffix), variant or none, of the best token of the text."""
    base = compact(wanted)
    tokens = F.transform(F.split(text, "\\s+"), lambda t: compact(t))
    rest = F.transform(F.filter(tokens, lambda t: t.startswith(base) & (base != "")), lambda t: F.substring(t, F.length(base) + 1, F.length(t)))
    kinds = F.transform(rest, lambda r: F.when(r == "", 0).when(suffix_kind(r) == "regional", 1).otherwise(2))
    return F.get(strings(("exact", "same_base", "variant", "none")), F.coalesce(F.array_min(kinds), F.lit(3)))


def model_match(model: Column, text: Column) -> Column:
    """exact: all parts of the model are tokens of the text; likely: its compact form is in it; mismatch: another token has
    its first four characters; unknown else."""
    parts = F.filter(F.split(F.upper(model), "[^A-Z0-9]+"), lambda p: p != "")
    tokens = F.filter(F.split(F.upper(text), "[^A-Z0-9]+"), lambda p: p != "")
    near = F.exists(tokens, lambda t: t.startswith(F.substring(compact(model), 1, 4)) & (F.length(compact(model)) >= 4))
    return F.when((F.size(parts) > 0) & (F.size(F.array_except(parts, tokens)) == 0), "exact").when((compact(model) != "") & compact(text).contains(compact(model)), "likely").when(near, "mismatch").otherwise("unknown")
