"""URL checks without name resolution; known addresses come in as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentspark.functions.binding import let

IPV4 = r"^(25[0-5]|2[0-4]\d|1\d\d|\d{1,2})(\.(25[0-5]|2[0-4]\d|1\d\d|\d{1,2})){3}$"
IPV4_TAIL = r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"

# Hosts refused by name.
BLOCKED_HOSTS = ("localhost", "127.0.0.1", "169.254.169.254")


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def url_domain(url: Column) -> Column:
    """Host of a URL, or ``default`` when there is none."""
    return F.coalesce(url_host(url), F.lit("default"))


def is_private_ipv4(address: Column) -> Column:
    """Any-local, private, shared, loopback, link-local, multicast and reserved ranges."""
    def private(octets: Column) -> Column:
        a, b = octets[0], octets[1]
        return (
            a.isin(0, 10, 127)
            | (a >= 224)
            | ((a == 172) & b.between(16, 31))
            | ((a == 192) & (b == 168))
            | ((a == 100) & b.between(64, 127))
            | ((a == 169) & (b == 254))
        )

    return let(F.transform(F.split(address, "[.]"), lambda o: o.try_cast("int")), private)


def _without_dotted_tail(text: Column) -> Column:
    """``::ffff:10.0.0.1`` as ``::ffff:a00:1``."""
    def hex_pair(octets: Column) -> Column:
        high, low = octets[0] * 256 + octets[1], octets[2] * 256 + octets[3]
        return F.concat(
            F.regexp_replace(text, IPV4_TAIL, ""), F.lower(F.hex(high)), F.lit(":"), F.lower(F.hex(low)))

    tail = F.transform(F.split(F.regexp_extract(text, IPV4_TAIL, 0), "[.]"), lambda o: o.try_cast("int"))
    return F.when(text.rlike(IPV4_TAIL), let(tail, hex_pair)).otherwise(text)


def _ipv6_digits(address: Column) -> Column:
    """The 32 hex digits of an IPv6 literal (zone dropped); NULL when it is not one."""
    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: g != "")

    def filled(left: Column, right: Column) -> Column:
        missing = F.lit(8) - F.size(left) - F.size(right)
        return F.when(missing >= 1, F.concat(left, F.array_repeat(F.lit("0"), missing), right))

    def expanded(text: Column) -> Column:
        halves = let(groups(F.split_part(text, F.lit("::"), F.lit(1))), lambda left: let(
            groups(F.split_part(text, F.lit("::"), F.lit(2))), lambda right: filled(left, right)))
        return F.when(text.contains("::"), halves).otherwise(groups(text))

    def digits(full: Column) -> Column:
        valid = (F.size(full) == 8) & F.forall(full, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(valid, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))

    plain = F.lower(F.regexp_replace(address, r"%.*$", ""))
    return let(let(let(plain, _without_dotted_tail), expanded), digits)


def _mapped_ipv4(digits: Column) -> Column:
    octets = [F.conv(F.substring(digits, 25 + 2 * i, 2), 16, 10) for i in range(4)]
    return F.concat_ws(".", *octets)


def is_private_ipv6(address: Column) -> Column:
    """Any-local, loopback, unique-local, link-local, site-local, multicast, or a private mapped IPv4."""
    return let(_ipv6_digits(address), lambda d: (
        d.isin("0" * 32, "0" * 31 + "1")
        | d.rlike("^(f[cd]|fe[89a-f]|ff)")
        | (d.startswith("0" * 20 + "ffff") & is_private_ipv4(_mapped_ipv4(d)))
    ))


def is_private_address(address: Column) -> Column:
    """True for an address no public URL may lead to; unreadable addresses count as private."""
    v4 = address.rlike(IPV4)
    return F.coalesce(
        F.when(v4, is_private_ipv4(address)).when(address.contains(":"), is_private_ipv6(address)),
        F.lit(True),
    )


def is_safe_url(url: Column, addresses: Column | None = None) -> Column:
    """True when a URL may be fetched.

    ``addresses`` holds what the host is known to resolve to (``array<string>``). A literal address
    stands for itself. A name without known addresses passes when it looks like a public name.
    """
    def checked(host: Column) -> Column:
        bare = F.lower(F.regexp_replace(host, r"^\[|\]$", ""))
        public_name = host.contains(".") & ~host.startswith(".") & ~host.endswith(".")
        verdict = F.when(bare.isin(*BLOCKED_HOSTS), F.lit(False)).when(
            host.startswith("[") | host.rlike(IPV4), ~let(bare, is_private_address))
        if addresses is not None:
            verdict = verdict.when(
                F.size(addresses) > 0,
                F.forall(addresses, lambda a: ~F.coalesce(is_private_address(a), F.lit(True))))
        return verdict.otherwise(public_name)

    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    allowed = F.when(scheme.isin("http", "https"), let(url_host(url), checked))
    return F.coalesce(allowed, F.lit(False))
