"""URL functions as Columns. Each normalization is its own function: they differ on purpose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query names that make a page a filtered or tracked variant.
PARAMETER_NAMES = ["filter", "sort", "orderby", "page", "paged", "variant", "color", "size", "brand", "min_price", "max_price", "q", "s", "search"]
PARAMETER_PREFIX = "^(filter|utm_|ref|session|sid|attribute|pa_)"
FACET_NAMES = ["filter", "filter_color", "filter_size", "filter_brand", "variant", "sort", "orderby", "min_price", "max_price", "color", "size", "brand", "page", "paged"]
FACET_PREFIX = "^(filter|attribute|pa_|utm_)"

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once: a Column used several times in an expression is otherwise evaluated as often."""
    return F.element_at(F.transform(F.array(value), then), 1)


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """Lower-case host without port."""
    return F.regexp_replace(F.lower(part(url, 2)), r":\d+$", "")


def site(url: Column) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(F.lower(part(url, 2)), r"^www\.|:\d+$", "")


def path(url: Column) -> Column:
    p = part(url, 3)
    return F.when(p == "", F.lit("/")).otherwise(p)


def search(url: Column) -> Column:
    return part(url, 4)


def authority(url: Column) -> Column:
    """Lower-case host, with the port unless it is the scheme's own."""
    own = F.when(scheme(url) == "http", F.lit(":(80)?$")).when(scheme(url) == "https", F.lit(":(443)?$")).otherwise(F.lit(":$"))
    return F.regexp_replace(F.lower(part(url, 2)), own, F.lit(""))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def strip_hash(url: Column) -> Column:
    """Without fragment, and without one trailing slash unless the path is /."""
    bare = F.regexp_replace(url, "#.*$", "")
    return F.when(path(url) == "/", bare).otherwise(F.regexp_replace(bare, "/$", ""))


def page_key(url: Column) -> Column:
    """Site and path without one trailing slash: no scheme, no query."""
    p = F.regexp_replace(path(url), "/$", "")
    return F.concat(site(url), F.when(p == "", F.lit("/")).otherwise(p))


def graph_key(url: Column) -> Column:
    """Scheme, site, path without trailing slashes, query."""
    p = F.when(path(url) == "/", F.lit("/")).otherwise(F.regexp_replace(path(url), "/+$", ""))
    return F.concat(scheme(url), F.lit("://"), site(url), p, search(url))


def https_key(url: Column) -> Column:
    return F.regexp_replace(graph_key(url), "^http:", "https:")


def sorted_key(url: Column) -> Column:
    """Without fragment, query parameters by name (equal names in their own order) and written the way forms write them, without a
    trailing slash."""
    parts = F.filter(F.split(F.substring(search(url), 2, 1 << 20), "&"), lambda x: x != "")
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    value = lambda x: F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")
    name = lambda x: plain(F.substring_index(x, "=", 1))
    named = F.transform(parts, lambda x, i: F.struct(name(x).alias("n"), i.alias("i"), F.concat(F.url_encode(name(x)), F.lit("="), F.url_encode(plain(value(x)))).alias("x")))
    q = F.array_join(F.transform(F.array_sort(named), lambda e: e["x"]), "&")
    base = F.concat(origin(url), path(url))
    whole = F.when(q != "", F.concat(base, F.lit("?"), q)).otherwise(F.regexp_replace(base, "/$", ""))
    return F.when(url.rlike(_PARTS), whole).otherwise(F.coalesce(url, F.lit("")))


def _web(url: Column) -> Column:
    """url with https:// before it unless it has http or https."""
    bare = F.translate(F.trim(F.coalesce(url, F.lit(""))), "\t\n\r", "")
    return F.when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def _escaped(part: Column, marks: str) -> Column:
    """part with blanks, control characters, marks and what isn't ASCII percent-encoded; what is encoded already stays."""
    odd = rf"""[\x00-\x20\x7f{marks}]|[^\x00-\x7f]"""
    one = lambda c: F.when(c.rlike(odd), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)
    return F.when(part.rlike(odd), F.array_join(F.transform(F.regexp_extract_all(part, F.lit("(?s)."), 0), one), "")).otherwise(part)


def _dotless(p: Column) -> Column:
    """A path whose dot segments are resolved, as browsers do it: a closing one leaves a slash, and none leads above the root."""
    dot, up = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"

    def step(done: Column, s: Column) -> Column:
        back = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(s.rlike(up), back).when(s.rlike(dot), done).otherwise(F.concat(done, F.array(s)))

    parts = F.slice(F.split(p, "/"), 2, 1 << 20)
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    closed = F.when(F.element_at(parts, -1).rlike(dot) | F.element_at(parts, -1).rlike(up), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(p.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(closed, "/"))).otherwise(p)


def _tidy(url: Column) -> Column:
    """Scheme and host in lower case, no default port, a path without dot segments, odd characters percent-encoded, no fragment. Hosts
    stay as they are but for their case: names with other letters than ASCII aren't turned into punycode."""
    p = _escaped(_dotless(F.translate(path(url), "\\", "/")), '"#<>?`{}^')
    return F.concat(origin(url), p, _escaped(search(url), "\"#<>'"))


#: An address that is in its usual form but for a scheme and the path of a bare host: lower-case host without port, no dot segments, nothing to encode, no fragment.
_USUAL = r"""^(https?://)?[a-z0-9.-]+(/(?!([^?]*/)?(?i:\.|%2e){1,2}(/|\?|$))[!$%&'()*+,\-./0-9:;=@A-Z\[\]_a-z|~]*(\?[!$%&()*+,\-./0-9:;=?@A-Z\[\]\\^_`a-z{|}~]*)?)?\z"""


def _usual(url: Column) -> Column:
    """An address that _USUAL matches, in its usual form."""
    whole = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.when(whole.rlike("^https?://[^/]*$"), F.concat(whole, F.lit("/"))).otherwise(whole)


_HOST = r"(?i)^https?://(\[[0-9a-f:.]+\]|[^/?#@\s:\[\]]+)(:\d*)?([/?#]|$)"


def normalize_url(url: Column) -> Column:
    """An audit's start address: https where no scheme is given, without fragment; null for other schemes, credentials and what isn't an address."""
    other = lambda x: x.rlike("(?i)^[a-z][a-z0-9+.-]*://") & ~x.rlike("(?i)^https?://")
    return let(F.trim(F.coalesce(url, F.lit(""))), lambda x: F.when(~other(x), let(_web(x), lambda w: F.when(w.rlike(_HOST), _tidy(w)))))


def http_url(url: Column) -> Column:
    """Like normalize_url, but a text that can't be read gives an empty one and credentials stay."""
    bare = F.trim(F.coalesce(url, F.lit("")))
    fine = lambda w: F.regexp_replace(w, "^([A-Za-z]+://)[^/?#@]*@", "$1").rlike(_HOST)
    other = let(_web(bare), lambda w: F.when(fine(w), _tidy(w)).otherwise(F.lit("")))
    return F.when(bare == "", F.lit("")).when(bare.rlike(_USUAL), _usual(bare)).otherwise(other)  # most addresses need one look


def traffic_key(url: Column) -> Column:
    """Site with any port but the scheme's own, and path without one trailing slash; the key that imported traffic is summed by."""
    bare = F.trim(F.coalesce(url, F.lit("")))
    where = F.regexp_replace(authority(bare), r"^www\.", "")
    p = F.when(F.length(path(bare)) > 1, F.regexp_replace(path(bare), "/$", "")).otherwise(path(bare))
    text = F.substring_index(bare, "#", 1)
    for pattern in ("^[a-zA-Z][a-zA-Z0-9+.-]*://", "(?i)^www\\.", "/$"):
        text = F.regexp_replace(text, pattern, "")
    return F.when(bare.rlike(_PARTS) & (part(bare, 2) != ""), F.concat(where, p)).otherwise(F.lower(F.trim(text)))


def account_key(url: Column) -> Column:
    """Scheme, host with port, path without trailing slashes, query; empty for what isn't an address."""
    return F.when(url.rlike(_PARTS), F.concat(origin(url), F.regexp_replace(path(url), "/+$", ""), search(url))).otherwise(F.lit(""))


def proof_key(url: Column) -> Column:
    """Without fragment and the path's trailing slashes; the key that finished pages are matched to a frontier by."""
    bare = F.substring_index(F.coalesce(url, F.lit("")), "#", 1)
    p = F.regexp_replace(path(bare), "/+$", "")
    return F.when(bare.rlike(_PARTS), F.concat(origin(bare), F.when(p == "", F.lit("/")).otherwise(p), search(bare))).otherwise(F.regexp_replace(bare, "/+$", ""))


def same_site(a: Column, b: Column) -> Column:
    """Whether two origins are equal or of one host, www aside."""
    return (a != "") & (b != "") & ((a == b) | ((site(a) != "") & (site(a) == site(b))))


def label(url: Column, start: Column) -> Column:
    """A page's name in findings: home if it is the start page, else its path."""
    return F.when(strip_hash(url) == strip_hash(start), F.lit("home")).otherwise(path(url))


def own_label(url: Column) -> Column:
    """home if the path is /, else the path."""
    return F.when(path(url) == "/", F.lit("home")).otherwise(path(url))


def search_label(url: Column) -> Column:
    return F.concat(path(url), search(url))


def html_response(url: Column, content_type: Column) -> Column:
    """Whether an answer is a page: by its type, where that says nothing by the address."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    vague = kind.contains("application/octet-stream") | kind.contains("binary/octet-stream") | kind.contains("text/plain")
    return kind.contains("text/html") | kind.contains("application/xhtml+xml") | (((kind == "") | vague) & likely_html(url))


def _names(url: Column) -> Column:
    return F.transform(F.split(F.substring(search(url), 2, 1 << 20), "&"), lambda x: F.lower(F.split(x, "=")[0]))


def parameter_risk(url: Column) -> Column:
    return F.exists(_names(url), lambda n: n.isin(PARAMETER_NAMES) | n.rlike(PARAMETER_PREFIX))


def faceted(url: Column) -> Column:
    return F.exists(_names(url), lambda n: n.isin(FACET_NAMES) | n.rlike(FACET_PREFIX))


def likely_html(url: Column) -> Column:
    return url.rlike(_PARTS) & ~F.lower(path(url)).rlike(r"\.(txt|xml|json|csv|pdf|png|jpe?g|gif|webp|svg|ico|css|js|map|zip)$")


#: Columns that against() reads, by SQL over a column url: the parts of a page's address that resolving needs, taken apart once a page.
BASE = {
    "_scheme": f"lower(regexp_extract(url, r'{_PARTS}', 1))",
    "_path": f"if(regexp_extract(url, r'{_PARTS}', 3) = '', '/', regexp_extract(url, r'{_PARTS}', 3))",
    "_bare": "regexp_replace(url, '#.*$', '')",
}


def _origin_sql(url: str) -> str:
    scheme, authority = f"lower(regexp_extract({url}, r'{_PARTS}', 1))", f"lower(regexp_extract({url}, r'{_PARTS}', 2))"
    return f"concat({scheme}, '://', regexp_replace({authority}, CASE {scheme} WHEN 'http' THEN ':(80)?$' WHEN 'https' THEN ':(443)?$' ELSE ':$' END, ''))"


BASE["_origin"] = _origin_sql("url")


def against(href: str) -> str:
    """absolute() as SQL text, for an address given as SQL in a row that has the columns of BASE. Within a lambda over many links a Column
    of this size would be put together once for each of its calls, and would take the page's own address apart for every link."""
    joined = f"""CASE WHEN {href} RLIKE '^[A-Za-z][A-Za-z0-9+.-]*:' THEN {href} WHEN startswith({href}, '//') THEN concat(_scheme, ':', {href})
      WHEN startswith({href}, '/') THEN concat(_origin, {href}) WHEN startswith({href}, '?') THEN concat(_origin, _path, {href})
      WHEN startswith({href}, '#') THEN concat(_bare, {href}) ELSE concat(_origin, regexp_replace(_path, '[^/]*$', ''), {href}) END"""
    path = f"if(regexp_extract(w, r'{_PARTS}', 3) = '', '/', regexp_extract(w, r'{_PARTS}', 3))"
    kept = f"""aggregate(slice(split({path}, '/'), 2, {1 << 20}), cast(array() AS array<string>), (done, s) ->
      CASE WHEN s = '.' THEN done WHEN s = '..' THEN slice(done, 1, greatest(size(done) - 1, 0)) ELSE concat(done, array(s)) END)"""
    tidy = f"concat({_origin_sql('w')}, '/', array_join({kept}, '/'), regexp_extract(w, r'{_PARTS}', 4), regexp_extract(w, r'{_PARTS}', 5))"
    dots = f"w RLIKE r'/\\.\\.?(/|$|\\?|#)' AND {path} RLIKE r'/\\.\\.?(/|$)'"
    return f"element_at(transform(array({joined}), w -> CASE WHEN {dots} THEN {tidy} ELSE w END), 1)"


def absolute(href: Column, base: Column) -> Column:
    """href against base; dot segments are resolved by a fold over the path's segments."""
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    joined = (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin(base), href))
        .when(href.startswith("?"), F.concat(origin(base), path(base), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(origin(base), folder, href))
    )

    def tidied(whole: Column) -> Column:
        kept = F.aggregate(
            F.slice(F.split(path(whole), "/"), 2, 1 << 20),
            F.array().cast("array<string>"),
            lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
        )
        tidy = F.concat(origin(whole), F.lit("/"), F.array_join(kept, "/"), search(whole), part(whole, 5))
        return F.when(whole.rlike(r"/\.\.?(/|$|\?|#)") & path(whole).rlike(r"/\.\.?(/|$)"), tidy).otherwise(whole)

    return let(joined, tidied)


def _octet(x: Column) -> Column:
    """A number of an IPv4 address: decimal, octal after a 0, hexadecimal after 0x; null for anything else."""
    return (
        F.when(x.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(x, 3, 64), 16, 10).try_cast("long"))
        .when(x.rlike("^0[0-7]+$"), F.conv(x, 8, 10).try_cast("long"))
        .when(x.rlike(r"^(0|[1-9]\d*)$"), x.try_cast("long"))
    )


def ipv4(h: Column) -> Column:
    """A host as the number of an IPv4 address: four parts, or one, in decimal, octal or hexadecimal; null if it is none."""
    parts = F.split(h, r"\.")
    good = lambda o: (F.size(o) == 4) & ~F.exists(o, lambda x: x.isNull() | (x > 255))
    four = lambda o: F.aggregate(o, F.lit(0).cast("long"), lambda n, x: n * 256 + x)
    dotted = let(F.transform(parts, _octet), lambda o: F.when(good(o), four(o)))
    return F.when(F.size(parts) == 4, dotted).when(h.rlike(r"^(\d+|0x[0-9a-f]+)$") & (_octet(h) <= 0xFFFFFFFF), _octet(h))


def mapped_ipv4(h: Column) -> Column:
    """The IPv4 number inside an IPv6 address that maps one, as four numbers or two hexadecimal groups; null if there is none."""
    dotted = F.regexp_extract(h, r"(?:^|:)ffff:(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    high, low = (F.conv(F.regexp_extract(h, "(?:^|:)ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", i), 16, 10).try_cast("long") for i in (1, 2))
    return F.when(dotted != "", ipv4(dotted)).when(h.rlike("(^|:)ffff:[0-9a-f]{1,4}:[0-9a-f]{1,4}$"), high * 65536 + low)


#: First and last address of the IPv4 ranges that aren't public.
PRIVATE_IPV4 = [
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("224.0.0.0", "255.255.255.255"),
]
PRIVATE_NAMES = ["localhost", "metadata", "metadata.google.internal"]
PRIVATE_ENDINGS = [".localhost", ".local", ".internal", ".invalid", ".home.arpa", ".cluster.local"]
PRIVATE_IPV6 = r"^(::|::1)$|^(fe80:|fe9|fea|feb|fc|fd|ff|2001:db8:)"


def private_host(h: Column) -> Column:
    """Hosts that aren't public: inner names and endings, private IPv4 in any notation, also mapped into IPv6, and private IPv6."""

    def inner(number: Column) -> Column:
        found = F.lit(False)
        for first, last in PRIVATE_IPV4:
            a, b = (sum(int(x) << 8 * (3 - i) for i, x in enumerate(y.split("."))) for y in (first, last))
            found = found | number.between(a, b)
        return found

    def private(x: Column) -> Column:
        named = x.isin("", *PRIVATE_NAMES)
        for ending in PRIVATE_ENDINGS:
            named = named | x.endswith(ending)
        six = x.contains(":") & F.regexp_replace(x, "^0+", "").rlike(PRIVATE_IPV6)
        number = F.when(x.contains(":"), mapped_ipv4(x)).when(x.rlike("^[0-9]"), ipv4(x))
        return named | let(number, lambda n: F.when(n.isNotNull(), inner(n)).otherwise(six))

    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(h, F.lit("")))), r"^\[|\]$", ""), r"\.$", "")
    return let(bare, private)


def auditable(url: Column) -> Column:
    """Whether an address may be audited: http or https, a host with a dot or colon, not a private one."""
    h = F.regexp_replace(F.lower(part(url, 2)), r":\d+$", "")
    return F.coalesce(scheme(url).isin("http", "https") & (h.contains(".") | h.contains(":")) & ~private_host(h), F.lit(False))
