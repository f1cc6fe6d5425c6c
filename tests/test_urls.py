import ipaddress
import random

from pyspark.sql import functions as F

from shelfwatch.functions.hosts import punycode
from shelfwatch.functions.urls import url_host, url_path, with_url_parts

CASES = [
    ("https://a.com/x/y", "a.com", "/x/y"),
    ("HTTPS://User:Pw@A.COM:8080/x", "a.com", "/x"),
    ("https://a_b.example.com", "a_b.example.com", "/"),
    ("http://a.com?q=1", "a.com", "/"),
    ("http://a.com/p?q=/z#f", "a.com", "/p"),
    ("http://a.com/été", "a.com", "/%C3%A9t%C3%A9"),
    ("http://a.com/a b|c", "a.com", "/a%20b|c"),
    ("http://a.com/😀", "a.com", "/%F0%9F%98%80"),
    ("http://a.com/a/../b/./c/..", "a.com", "/b/"),
    ("http://a.com/%2e%2E/x", "a.com", "/x"),
    ("http://a.com\\p\\q", "a.com", "/p/q"),
    ("  http://a.com/x  ", "a.com", "/x"),
    ("http://a.com/x ?q", "a.com", "/x%20"),
    ("http://[::1]:80/x", "[::1]", "/x"),
    ("http://a.com:port/x", None, None),
    ("http://a.com:65535/x", "a.com", "/x"),
    ("http://a.com:00080/x", "a.com", "/x"),
    ("http://a.com:65536/x", None, None),
    ("http://a.com:99999/x", None, None),
    ("https:///a.com/x", "a.com", "/x"),
    ("https:\\\\a.com/x", "a.com", "/x"),
    ("https://%61.com/x", "a.com", "/x"),
    ("https://a%2Fb.com/x", None, None),
    ("https://a%zz.com/x", None, None),
    ("http://10.0.0.1/x", "10.0.0.1", "/x"),
    ("http://10.0.0.256/x", None, None),
    ("ftp://a.com/x", None, None),
    ("http://a b.com/x", None, None),
    ("http:///x", "x", "/"),
    ("", None, None),
    (None, None, None),
]

STANDARD = [
    ("https://bücher.example/x", "xn--bcher-kva.example", "/x"),
    ("https://MÜNCHEN.De:443/", "xn--mnchen-3ya.de", "/"),
    ("https://faß.de", "xn--fa-hia.de", "/"),
    ("https://例え.テスト/a", "xn--r8jz45g.xn--zckzah", "/a"),
    ("https://b%C3%BCcher.example", "xn--bcher-kva.example", "/"),
    ("https://a。ü．com", "a.xn--tda.com", "/"),
    ("https://xn--bcher-kva.example/x", "xn--bcher-kva.example", "/x"),
    ("http://😀.la/x", "xn--e28h.la", "/x"),
    ("http://0x7f.1/x", "127.0.0.1", "/x"),
    ("http://0X7F.0.0.1", "127.0.0.1", "/"),
    ("http://017700000001", "127.0.0.1", "/"),
    ("http://2130706433/x", "127.0.0.1", "/x"),
    ("http://192.168.257", "192.168.1.1", "/"),
    ("http://010.0.0.1.", "8.0.0.1", "/"),
    ("http://0x.0x.0", "0.0.0.0", "/"),
    ("http://4294967295", "255.255.255.255", "/"),
    ("http://4294967296", None, None),
    ("http://1.2.3.4.5", None, None),
    ("http://1.2.3.09", None, None),
    ("http://256.1.1", None, None),
    ("http://a.1", None, None),
    ("http://99999999999999999999999", None, None),
    ("http://1.2.3.4.com", "1.2.3.4.com", "/"),
    ("http://0x.com", "0x.com", "/"),
    ("http://[0:0:0:0:0:0:0:1]", "[::1]", "/"),
    ("http://[2001:DB8:0:0:1:0:0:1]:8080/x", "[2001:db8::1:0:0:1]", "/x"),
    ("http://[2001:db8:0:1:1:1:1:1]", "[2001:db8:0:1:1:1:1:1]", "/"),
    ("http://[::ffff:192.168.0.1]", "[::ffff:c0a8:1]", "/"),
    ("http://[1:0:0:2:0:0:0:3]", "[1:0:0:2::3]", "/"),
    ("http://[00a::]", "[a::]", "/"),
    ("http://[1::2::3]", None, None),
    ("http://[1:2:3]", None, None),
    ("http://[::1.2.3.256]", None, None),
    ("http://[12345::]", None, None),
]


def test_host_and_path(column):
    cases = CASES + STANDARD
    urls = [c[0] for c in cases]
    assert column(url_host, urls) == [c[1] for c in cases]
    assert column(url_path, urls) == [c[2] for c in cases]


def test_punycode(column):
    pick = random.Random(6)
    letters = "abz019-" + "äöüßéñ" + "αβγδως" + "жщя" + "日本語テスト" + "😀🎮" + "\u0080\uffff"
    labels = ["".join(pick.choices(letters, k=pick.randint(1, 30))) for _ in range(300)]
    labels = [x for x in labels if not x.isascii()] + ["ü" * 60, "日" * 60 + "a"]
    assert column(punycode, labels) == ["xn--" + x.encode("punycode").decode() for x in labels]


def plain_ipv4(host):
    parts = host.removesuffix(".").split(".")
    values = []
    for p in parts:
        base = 16 if p.startswith("0x") else 8 if len(p) > 1 and p.startswith("0") else 10
        try:
            values.append(int(p[2:] or "0", 16) if base == 16 else int(p, base))
        except ValueError:
            return None
    if len(parts) > 4 or any(v > 255 for v in values[:-1]) or values[-1] >= 256 ** (5 - len(parts)):
        return None
    number = values[-1] + sum(v * 256 ** (3 - i) for i, v in enumerate(values[:-1]))
    return str(ipaddress.IPv4Address(number))


def test_numeric_hosts(column):
    pick = random.Random(7)
    numbers = ["0", "1", "255", "256", "0x", "0xff", "0x100", "010", "08", "0377", "0400", "65535", "16777215", "16777216", "4294967295", "4294967296"]
    hosts = [".".join(pick.choices(numbers, k=pick.randint(1, 5))) + pick.choice(["", "", "."]) for _ in range(400)]
    assert column(lambda c: url_host(F.concat(F.lit("http://"), c, F.lit("/x"))), hosts) == [plain_ipv4(h) for h in hosts]


def test_bracketed_hosts(column):
    pick = random.Random(8)
    hosts = [":".join(pick.choices(["0", "00", "0000", "1", "ab", "F0F0"], weights=[6, 1, 1, 1, 1, 1], k=8)) for _ in range(200)]
    hosts += ["::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4", "1::8.8.8.8", ":1", "1:", ":::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:1.2.3.4", "::01.2.3.4"]

    def expected(h):
        try:
            a = ipaddress.IPv6Address(h)
        except ValueError:
            return None
        groups = [f"{int.from_bytes(a.packed[i : i + 2]):x}" for i in range(0, 16, 2)]
        runs = [(n, -i) for i in range(8) for n in range(2, 9 - i) if groups[i : i + n] == ["0"] * n]
        if not runs:
            return f"[{':'.join(groups)}]"
        n, i = max(runs)
        return f"[{':'.join(groups[:-i])}::{':'.join(groups[-i + n:])}]"

    assert column(lambda c: url_host(F.concat(F.lit("http://["), c, F.lit("]/x"))), hosts) == [expected(h) for h in hosts]


def test_parts_equal_columns(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "url string")
    rows = with_url_parts(df).withColumn("h", url_host(F.col("url"))).withColumn("p", url_path(F.col("url"))).collect()
    assert all((r.host, r.path) == (r.h, r.p) for r in rows)
