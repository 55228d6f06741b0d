"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public suffixes of more than one label, private ones (hosting platforms) included. Fixed values, a selection: the whole
#: list is data of its own and can be given as a table, see with_registrable_domain().
SUFFIXES = tuple("""
co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk com.au net.au org.au co.nz org.nz co.jp ne.jp or.jp ac.jp co.kr com.br net.br com.ar
com.mx com.tr com.cn net.cn org.cn com.hk com.tw com.sg co.in net.in org.in co.za co.il com.pl net.pl org.pl com.ru org.ru pp.ru msk.ru
spb.ru com.ua net.ua org.ua in.ua edu.ua gov.ua kiev.ua kyiv.ua kharkov.ua kharkiv.ua odessa.ua odesa.ua lviv.ua dp.ua dnipro.ua zp.ua
cherkassy.ua pp.ua biz.ua co.ua com.kz org.kz com.by com.ge com.md com.uz github.io gitlab.io blogspot.com herokuapp.com netlify.app
vercel.app web.app firebaseapp.com pages.dev azurewebsites.net cloudfront.net s3.amazonaws.com
""".split())  # fmt: skip
IPV4 = r"^(\d{1,3}\.){3}\d{1,3}$"
IPV6 = r"^\[?[0-9a-fA-F:.]*:[0-9a-fA-F:.]*\]?$"


def _text(c: Column | str) -> Column:
    return F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))


def _with_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))


#: Scheme, user, then a bracketed or plain host; one pattern, as the expression is used many times over.
HOST = r"(?s)^(?:[^:/?#]*://)?(?:[^@/?#]*@)?(?:\[([^\]]*)\]|([^:/?#\[]*)).*$"


def host(url: Column | str) -> Column:
    """Lower-case host of a URL or bare host, without user, port and brackets; "" if there is none."""
    return F.regexp_replace(F.lower(_text(url)), HOST, "$1$2")


def is_ip(name: Column) -> Column:
    return name.rlike(IPV4) | name.rlike(IPV6)


def without_www(name: Column) -> Column:
    return F.regexp_replace(name, r"^www\.", "")


def registrable_domain(url: Column | str, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The label before the longest public suffix, with that suffix; an IP address as it is; "" for a bare suffix or label.
    A last label that no suffix of several labels covers is a suffix."""
    name = host(url)
    # The leftmost label that a suffix or a last label follows: the longest suffix wins.
    pattern = r"(?:^|\.)([^.]+\.(?:" + "|".join(x.replace(".", r"\.") for x in suffixes) + r"|[^.]+))$"
    return F.when(is_ip(name), name).when(name.isin(*suffixes), "").otherwise(F.regexp_extract(name, pattern, 1))


def with_registrable_domain(rows: DataFrame, url: str, suffixes: DataFrame, name: str = "domain") -> DataFrame:
    """The same by a table of suffixes (suffix, of any number of labels), joined on the tails of each host; the longest wins.
    rows must have no columns _id, _tail or suffix."""
    labelled = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_host", host(url))
    labels = F.split("_host", r"\.")
    tails = labelled.select("_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.slice(labels, n, F.size(labels)))).alias("_t")).select("_id", F.size("_t").alias("_n"), F.array_join("_t", ".").alias("_tail"))
    longest = tails.join(suffixes.select(F.lower("suffix").alias("_tail")).distinct(), "_tail").groupBy("_id").agg(F.max("_n").alias("_n"))
    size = F.coalesce(F.col("_n"), F.lit(1))
    out = labelled.join(longest, "_id", "left")
    domain = F.when(F.size(labels) > size, F.array_join(F.slice(labels, F.greatest(F.size(labels) - size, F.lit(1)), size + 1), ".")).otherwise("")
    return out.withColumn(name, F.when(F.col("_host") == "", "").when(is_ip(F.col("_host")), F.col("_host")).otherwise(domain)).drop("_id", "_host", "_n")


def match_domain(url: Column | str) -> Column:
    """Registrable domain; else the host without www. (single labels); an IP address or what has no host as it was given."""
    name, u = host(url), _text(url)
    return F.when((name == "") | is_ip(name), u).otherwise(F.coalesce(F.nullif(registrable_domain(url), F.lit("")), without_www(name)))


def match_url(url: Column | str) -> Column:
    """Scheme (https if none), host without www. and path without slashes at its end; no port, query or fragment."""
    u = _text(url)
    full = _with_scheme(u)
    scheme = F.lower(F.regexp_extract(full, r"^([^:/?#]*)://", 1))
    path = F.regexp_replace(F.regexp_extract(full, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.when(u == "", "").otherwise(F.concat(F.coalesce(F.nullif(scheme, F.lit("")), F.lit("https")), F.lit("://"), without_www(host(u)), path))


def absolute(href: Column, base: Column) -> Column:
    """href seen from base: full URLs, //host, /path, ?query and names beside the base's last part; . and .. are not resolved."""
    origin = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.rlike(r"://[^/]*$"), F.concat(folder, F.lit("/"))).otherwise(folder)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^([^:/?#]+:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href)).when(F.startswith(href, F.lit("?")), F.concat(page, href)).when(href == "", page).otherwise(F.concat(folder, href))
    )


def normalized(url: Column | str, base: Column | None = None) -> Column:
    """Absolute URL with lower-case scheme and host, its port, sorted query parameters, no fragment and a path of / at least; "" without host."""
    u = _text(url)
    u = u if base is None else absolute(u, _text(base))
    scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z][^:/?#]*)://", 1))
    port = F.regexp_extract(u, r"^[^:/?#]*://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    path = F.regexp_extract(u, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    name = F.when(scheme == "", "").otherwise(host(u))
    full = F.concat(scheme, F.lit("://"), name, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), F.when(path == "", "/").otherwise(path), F.when(pairs != "", F.concat(F.lit("?"), pairs)).otherwise(""))
    return F.when(name == "", "").otherwise(full)


def same_domain(target: Column, current: Column) -> Column:
    """Equal hosts, one below the other, or the same registrable domain."""
    t, c = (F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\.+$", "") for x in (target, current))
    root = lambda x: F.coalesce(F.nullif(registrable_domain(x), F.lit("")), x)
    return (t != "") & (c != "") & ((t == c) | F.endswith(t, F.concat(F.lit("."), c)) | F.endswith(c, F.concat(F.lit("."), t)) | (root(t) == root(c)))


def blocked_ip(name: Column) -> Column:
    """Loopback, private, link-local, shared, multicast and reserved literal addresses."""
    octet = lambda i: F.get(F.split(name, r"\."), F.lit(i)).try_cast("int")
    a, b = octet(0), octet(1)
    v4 = name.rlike(IPV4) & (a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19)))
    v6 = F.lower(name).rlike(r"^\[?(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*)\]?$")
    return v4 | (F.contains(name, F.lit(":")) & v6)


def is_safe(url: Column | str) -> Column:
    """http or https to a host that isn't local, internal or a blocked address. Names are not resolved."""
    u, name = _text(url), host(url)
    local = name.isin("localhost", "") | name.rlike(r"\.(local|internal|localhost|localdomain)$")
    return u.rlike(r"(?i)^https?://") & ~local & ~blocked_ip(name)


def validated(url: Column | str) -> Column:
    """A URL fit for fetching, https:// put in front of bare domains; null if it is none or not safe."""
    u = _text(url)
    full = F.when(u.rlike(r"(?i)^https?://"), u).when(u.rlike(r"^[a-zA-Z0-9]([a-zA-Z0-9-]*\.)+[a-zA-Z]{2,}([/:?#].*)?$"), F.concat(F.lit("https://"), u))
    return F.when(full.rlike(r"^[hH][tT]{2}[pP][sS]?://[^\s/?#]+\.[^\s]+$") & is_safe(full), full)


def displayed_domain(displayed_link: Column, url: Column) -> Column:
    """The trimmed displayed link, else the host (with its port) of the URL without www."""
    shown = _text(displayed_link)
    authority = F.regexp_replace(F.regexp_extract(_text(url), r"^[^:/?#]+://([^/?#]*)", 1), r"^www\.", "")
    return F.when(shown != "", shown).otherwise(authority)
