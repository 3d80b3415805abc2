"""Allow and deny lists: normalised values, ranges of addresses, and who was on a list when."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("ip", "email", "country", "bin", "asn", "account", "device")


def _dotted(plain: Column) -> Column:
    """An IPv4 address as a number; null if it isn't one."""
    part = lambda i: F.regexp_extract(plain, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("long")
    parts = [part(i) for i in range(1, 5)]
    ok = F.lit(True)
    for p in parts:
        ok = ok & p.between(0, 255)
    return F.when(ok, parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3])


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _ip6_hex(plain: Column) -> Column:
    """An IPv6 address in lower case as 32 hex digits; null if it isn't one. The last 32 bits may be a dotted IPv4 address."""

    def spread(full: Column) -> Column:
        ends = F.split(full, "::")
        groups = lambda i: F.filter(F.split(F.coalesce(F.get(ends, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
        digits = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")
        n = F.size(groups(0)) + F.size(groups(1))
        form = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
        ok = F.when(F.contains(full, F.lit("::")), full.rlike(f"^(?:{form})?::(?:{form})?$") & (n <= 7)).otherwise(full.rlike(f"^{form}$") & (n == 8))
        return F.when(ok, F.concat(digits(groups(0)), F.repeat(F.lit("0"), 32 - 4 * n), digits(groups(1))))

    dotted = _dotted(F.regexp_extract(plain, "[^:]*$", 0))
    joined = _let(F.lpad(F.hex(dotted), 8, "0"), lambda low: F.concat(F.regexp_replace(plain, "[^:]+$", ""), F.lower(low.substr(1, 4)), F.lit(":"), F.lower(low.substr(5, 4))))
    # other dots than those of a number at the end are refused with all that isn't a hex digit
    return _let(F.when(F.contains(plain, F.lit(":")), F.coalesce(joined, plain)), spread)


_MAPPED = "0" * 20 + "ffff"


def ip_bits(address: Column, unmap: bool = True) -> Column:
    """An address as binary digits: 32 for IPv4, 128 for IPv6; null if it is neither, or has a zone.

    With unmap, mapped addresses (::ffff:a.b.c.d) count as theirs, whatever their zone.
    """

    def parsed(v: Column) -> Column:
        four = F.lpad(F.conv(_dotted(v).cast("string"), 10, 2), 32, "0")
        return F.coalesce(four, _let(_ip6_hex(F.regexp_replace(v, "%.+$", "") if unmap else v), lambda six: binary(v, six)))

    def binary(v: Column, six: Column) -> Column:
        bits = F.concat(*(F.lpad(F.conv(six.substr(i, 8), 16, 2), 32, "0") for i in (1, 9, 17, 25)))
        if not unmap:
            return bits
        return F.when(six.startswith(_MAPPED), F.lpad(F.conv(six.substr(25, 8), 16, 2), 32, "0")).when(~F.contains(v, F.lit("%")), bits)

    return _let(F.lower(F.trim(address)), parsed)


def _ip6_text(groups: Column) -> Column:
    """The shortest form of eight groups without zeros in front: the first of the longest runs of zero groups is ::."""
    run = lambda k: rf"(?:^|:)0(?::0){{{k - 1}}}(?:$|:)"
    found = [F.when(groups.rlike(run(k)), F.regexp_replace(groups, f"^(.*?){run(k)}(.*)$", "$1::$2")) for k in range(8, 1, -1)]
    return F.coalesce(*found, groups)


def _ip_form(v: Column) -> Column:
    """An address of either family in the form that it is written in; null if it isn't one."""

    def form(six: Column) -> Column:
        n = F.coalesce(_dotted(v), F.when(six.startswith(_MAPPED), F.conv(six.substr(25, 8), 16, 10).cast("long")))
        four = _let(n, lambda n: F.when(n.isNotNull(), F.concat_ws(".", *(F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))))
        groups = F.when(six.isNotNull(), F.concat_ws(":", *(F.regexp_replace(six.substr(i, 4), "^0{1,3}", "") for i in range(1, 33, 4))))
        return F.coalesce(four, F.concat(_let(groups, _ip6_text), F.regexp_extract(v, "(%.+)$", 1)))

    return _let(_ip6_hex(F.regexp_replace(F.lower(v), "%.+$", "")), form)


def normalise(klass: str, value: Column) -> Column:
    """The form that values are compared in; null if the value isn't one of its class."""
    v = F.trim(F.coalesce(value, F.lit("")))
    low = F.lower(v)
    if klass == "ip":
        return _let(v, _ip_form)
    if klass == "email":
        return F.when(low.rlike(r"^[^@\s]+@[^@\s]+$"), low)
    if klass == "country":
        return F.when(v.rlike(r"^[A-Za-z]{2}$"), F.upper(v))
    if klass in ("bin", "asn"):
        digits = F.regexp_replace(low, "^as", "") if klass == "asn" else v
        return F.when(digits.rlike(r"^\d+$"), digits)
    if klass in ("account", "device"):
        return F.when(v != "", v)
    raise ValueError(f"unknown class {klass}")


def live(at: Column) -> Column:
    """Entries (removed, until) that hold at an instant."""
    return ~F.coalesce(F.col("removed"), F.lit(False)) & (F.col("until").isNull() | (F.col("until") > at))


def cidr(entries: DataFrame) -> DataFrame:
    """Range entries with family (bits of an address), prefix (bits) and the network (its first prefix binary digits).

    A range in the mapped form (::ffff:a.b.c.d/n) is one of IPv6 and holds no address, since mapped addresses count as IPv4.
    """
    value = F.trim("value")
    address = ip_bits(F.substring_index(value, "/", 1), unmap=False)
    family = F.length(address)
    bits = F.when(F.contains(value, F.lit("/")), F.regexp_extract(value, r"^[^/]*/(\d+)$", 1).try_cast("int")).otherwise(family)
    found = entries.select("list", "class", "value", family.alias("family"), bits.alias("prefix"), F.substring(address, F.lit(1), bits).alias("network"))
    return found.where("network is not null and prefix between 0 and family")


def listed(df: DataFrame, column: str, entries: DataFrame, at: Column) -> DataFrame:
    """df with lists: the names of all lists that hold column's value, by an exact entry or a range.

    entries: list, class, value, range, removed, until. Addresses are compared in their normalised form. Every prefix length
    in use is an equi-join on an address's first binary digits, so a range takes no comparison of all pairs. There are 33
    lengths of IPv4 at most, and 129 of IPv6; a range of one family holds no address of the other.
    """
    held = entries.where(live(at))
    exact = held.where("not coalesce(range, false)").select("list", F.coalesce(F.col("class") == "ip", F.lit(False)).alias("is_ip"), "value")
    hosts = exact.where("is_ip").select("list", F.coalesce(normalise("ip", F.col("value")), F.col("value")).alias("value")).distinct()
    exact = exact.where("not is_ip").select("list", "value").distinct()
    ranges = cidr(held.where("range"))
    keys = df.select(F.col(column).alias("v")).distinct()
    by_value = keys.join(exact, F.trim("v") == F.col("value")).select("v", "list")
    by_host = keys.join(hosts, F.coalesce(normalise("ip", F.col("v")), F.trim("v")) == F.col("value")).select("v", "list")
    address = keys.withColumn("bits", ip_bits(F.col("v"))).where("bits is not null").withColumn("family", F.length("bits"))
    lengths = ranges.select("family", "prefix").distinct()
    masked = address.join(F.broadcast(lengths), "family").withColumn("network", F.substring("bits", F.lit(1), F.col("prefix")))
    by_range = masked.join(ranges, ["family", "prefix", "network"]).select("v", "list")
    found = by_value.unionByName(by_host).unionByName(by_range).groupBy("v").agg(F.sort_array(F.collect_set("list")).alias("lists"))
    return df.join(found, F.col(column) == F.col("v"), "left").drop("v").withColumn("lists", F.coalesce("lists", F.array().cast("array<string>")))


def current(changes: DataFrame) -> DataFrame:
    """The latest state of each entry of an append-only log (list, value, at, ...)."""
    w = Window.partitionBy("list", "value").orderBy(F.desc("at"))
    return changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def page(entries: DataFrame, name: str, most: int = 500) -> tuple[DataFrame, bool]:
    """The first entries of a list by value, and whether there are more."""
    found = entries.where(F.col("list") == name).orderBy("value").limit(most + 1)
    return found.limit(most), found.count() > most
