"""Column functions on text: folding, content classes, entropy, names, hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: How a line of code starts, and one with a key and a value; extensions of files that can run or install something.
CODE_START = r"(import\s+\S|from\s+\S+\s+import\s|def\s+\w+|class\s+\w+|function\s+\w+|const\s+\w+\s*=|let\s+\w+\s*=|var\s+\w+\s*=|#include\s*[<\"]|package\s+\w+|fn\s+\w+\(|public\s+class)"
KV_START = r"[A-Za-z_][A-Za-z0-9_.\-]*\s*[:=]\s*\S"
RISKY_EXTENSIONS = ["exe", "scr", "com", "pif", "msi", "msp", "mst", "appx", "appxbundle", "msix", "bat", "cmd", "vbs", "vbe", "wsf", "wsh", "ps1", "psm1", "psd1", "sh", "dll", "sys", "reg", "app", "pkg", "dmg", "deb", "rpm", "jar", "class", "iso", "img", "vhd", "vhdx"]
#: Blanks before the start stay within the line: as many matches, without reading runs of empty lines again and again.
CODE_LINE, KV_LINE = (rf"(?m)^[ \t\f\r]*{start}" for start in (CODE_START, KV_START))


def fold(c: Column) -> Column:
    """A-Z lower-cased, so that all engines agree and byte offsets stay."""
    return F.translate(c, UPPER, LOWER)


def looks_like_json(t: Column) -> Column:
    return t.contains("{") & t.contains("}") & (t.contains('":') | t.contains('" :'))


def looks_like_csv(t: Column) -> Column:
    """Three lines with commas or more, all with the same number; lines without are passed over."""
    commas = F.filter(F.transform(F.split(t, "\n", -1), lambda x: F.length(x) - F.length(F.translate(x, ",", ""))), lambda n: n > 0)
    return (F.size(commas) >= 3) & (F.array_min(commas) == F.array_max(commas))


def space_ratio(t: Column) -> Column:
    return F.when(F.length(t) > 0, (F.length(t) - F.length(F.translate(t, " \t", ""))) / F.length(t)).otherwise(F.lit(0.0))


def content_type(text: Column) -> Column:
    """code, structured, credentials or natural; the first that fits. Null and empty texts are natural."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.regexp_count(t, F.lit(CODE_LINE)) >= 2, "code")
        .when(looks_like_json(t) | looks_like_csv(t), "structured")
        .when((F.regexp_count(t, F.lit(KV_LINE)) >= 3) & (space_ratio(t) < 0.18), "credentials")
        .otherwise("natural")
    )


def entropy(value: Column) -> Column:
    """Bits per byte of the value's UTF-8 bytes, rounded to 12 places."""
    codes = F.filter(F.split(F.hex(F.encode(value, "utf-8")), "(?<=\\G..)"), lambda x: x != "")
    n = F.octet_length(value).cast("double")
    share = F.transform(F.array_sort(F.array_distinct(codes)), lambda b: F.size(F.filter(codes, lambda x: x == b)) / n)
    return F.when(n > 0, F.round(F.aggregate(share, F.lit(0.0), lambda h, p: h - p * F.log2(p)), 12)).otherwise(F.lit(0.0))


def extension(name: Column) -> Column:
    """The last part after a dot of the last path segment, in lower case; empty for names that only start or end with a dot."""
    return F.regexp_extract(fold(F.regexp_replace(name, r"^.*[/\\]", "")), r"^.+\.([^.]+)$", 1)


def normal_extensions(names: Column) -> Column:
    return F.filter(F.transform(names, lambda x: fold(F.regexp_replace(F.trim(x), r"^\.", ""))), lambda x: x != "")


def is_risky(name: Column, extensions: list[str] | None = None) -> Column:
    """None: the default list; an empty list: nothing is risky."""
    wanted = RISKY_EXTENSIONS if extensions is None else extensions
    return extension(name).isin(wanted) if wanted else F.lit(False)


def normal_domain(c: Column) -> Column:
    """Lower case, without scheme, path, query and fragment; null if blanks are left inside."""
    host = F.regexp_extract(F.regexp_replace(fold(F.trim(c)), "^[a-z][a-z0-9+.-]*://", ""), "^([^/?#]*)", 1)
    return F.when((host != "") & ~host.rlike(r"[ \t]"), host)


def strip_port(host: Column) -> Column:
    """host:port, [v6]:port and [v6] without port and brackets; a bare v6 address stays."""
    return F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).when(F.length(host) - F.length(F.translate(host, ":", "")) > 1, host).otherwise(F.regexp_replace(host, ":[0-9]*$", ""))


def split_address(address: Column) -> Column:
    """Struct host, port (text) around the last colon; an address without one is the host, and its port is empty."""
    last = r"(?s)^(.*):([^:]*)$"
    whole = ~address.contains(":")
    return F.struct(F.when(whole, address).otherwise(F.regexp_extract(address, last, 1)).alias("host"), F.when(whole, "").otherwise(F.regexp_extract(address, last, 2)).alias("port"))


def base_name(path: Column) -> Column:
    """The last part of a path, slashes at its end left out; a dot for an empty path, a slash for one of slashes only."""
    cut = F.regexp_replace(path, "/+$", "")
    return F.when(path == "", ".").when(cut == "", "/").otherwise(F.regexp_extract(cut, "(?s)([^/]*)$", 1))


def plausible_host(c: Column) -> Column:
    return c.rlike(r"^(?=.{1,253}$)[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+$")


def is_internal_ip(ip: Column) -> Column:
    """Loopback, link-local, private, multicast and unspecified addresses, IPv4 and IPv6 (perhaps with an IPv4 address inside or a zone)."""
    low = fold(F.regexp_replace(F.trim(ip), "%.*$", ""))
    inner = F.regexp_replace(low, r"^::(?:ffff:)?(?=\d+\.)", "")
    o = lambda i: F.split(inner, r"\.")[i].cast("int")
    inside = o(0).isin(0, 10, 127) | ((o(0) == 169) & (o(1) == 254)) | ((o(0) == 192) & (o(1) == 168)) | ((o(0) == 172) & o(1).between(16, 31)) | o(0).between(224, 239)
    six = low.rlike(r"^(?:(?:0{1,4}:){1,7}|::)(?:0{1,4}:)*0{0,3}[01]?$|^fe[89ab][0-9a-f]:|^f[cd][0-9a-f]{2}:|^ff[0-9a-f]{2}:")
    return F.when(inner.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), inside).when(low.contains(":"), six).otherwise(F.lit(False))


def category_name(file_name: Column) -> Column:
    """ai_chat_dlp.txt -> AI Chat DLP."""
    stem = F.regexp_replace(F.regexp_replace(file_name, "^.*/", ""), r"\.[^.]*$", "")
    return F.array_join(F.transform(F.filter(F.split(fold(stem), "[_-]"), lambda x: x != ""), lambda x: F.when(x.isin("ai", "dlp"), F.upper(x)).otherwise(F.initcap(x))), " ")


def fingerprint(text: Column) -> Column:
    """length:hash of UTF-16 units by 32-bit FNV-1a, as hexadecimal without leading zeros."""
    units = F.filter(F.split(F.hex(F.encode(text, "UTF-16BE")), "(?<=\\G....)"), lambda x: x != "")
    step = lambda h, u: ((h.bitwiseXOR(F.conv(u, 16, 10).cast("long"))) * 16777619).bitwiseAND(F.lit(4294967295))
    return F.concat_ws(":", F.size(units).cast("string"), F.lower(F.hex(F.aggregate(units, F.lit(2166136261).cast("long"), step))))


def url_component(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))


def form_body(names: Column, values: Column) -> Column:
    """k=v&k=v of two arrays, encoded."""
    return F.array_join(F.zip_with(names, values, lambda k, v: F.concat(url_component(k), F.lit("="), url_component(v))), "&")


def slug(c: Column, most: int = 24) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(fold(c), "[ _/.-]+", "-"), "[^a-z0-9-]", ""), "-+", "-")
    return F.regexp_replace(F.left(F.regexp_replace(s, "^-|-$", ""), F.lit(most)), "-$", "")


def uptime(seconds: Column) -> Column:
    d, h, m = F.floor(seconds / 86400), F.floor(seconds % 86400 / 3600), F.floor(seconds % 3600 / 60)
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(d > 0, F.concat_ws(" ", part(d, "d"), part(h, "h"), part(m, "m"))).when(h > 0, F.concat_ws(" ", part(h, "h"), part(m, "m"))).otherwise(part(m, "m"))


def label(c: Column, most: int = 80) -> Column:
    """Printable ASCII only, cut: what may be shown."""
    return F.left(F.regexp_replace(c, r"[^\x20-\x7e]", ""), F.lit(most))
