import ipaddress
import random

from pyspark.sql import functions as F

from pagelens.functions import hosts
from pagelens.functions.urls import is_http_url, normalize_url

# Sample strings of RFC 3492, section 7.1, that have no upper-case letters beyond ASCII.
VECTORS = {
    "ليهمابتكلموشعربي؟": "egbpdaj6bu4bxfgehfvwxn", "他们为什么不说中文": "ihqwcrb4cv8a8dqg056pqjye", "他們爲什麽不說中文": "ihqwctvzc91f659drss3x8bo0yb",
    "למההםפשוטלאמדבריםעברית": "4dbcagdahymbxekheh6e0a7fei0b", "почемужеонинеговорятпорусски": "b1abfaaepdrnnbgefbadotcwatmq2g4l",
    "3年b組金八先生": "3b-ww4c5e180e575a65lsy2b", "安室奈美恵-with-super-monkeys": "-with-super-monkeys-pc58ag80a8qai00g7n9n",
    "ひとつ屋根の下2": "2-u9tlzr9756bt3uc0v", "majiでkoiする5秒前": "majikoi5-783gue6qz075azm5e", "パフィーdeルンバ": "de-jg4avhby1noc0d", "そのスピードで": "d9juau41awczczp",
}


def valid(host):
    return F.when(hosts.is_valid(hosts.printed(host)), hosts.printed(host))


def test_encoder(evaluate):
    rng = random.Random(4)
    labels = list(VECTORS) + ["bücher", "ß", "é", "aé", "éa", "a-é-b", "日本語", "😀", "a😀b😀", "é" * 30, "ééàà" * 8, "x" * 50 + "é"]
    labels += ["".join(rng.choice("abcé日ü😀あい-1") for _ in range(rng.randint(1, 40))) + "é" for _ in range(300)]
    rows = evaluate([(x,) for x in labels], "h string", valid(F.concat("h", F.lit(".test"))))
    for label, got in zip(labels, rows, strict=True):
        want = "xn--" + label.encode("punycode").decode()
        assert got == (want + ".test" if len(want) <= 63 else None), label
    for label, code in VECTORS.items():
        assert rows[labels.index(label)] == f"xn--{code}.test"


NAMES = {
    "BÜCHER.test": "xn--bcher-kva.test", "b%C3%BCcher.test": "xn--bcher-kva.test", "B%C3%9CCHER.TEST": "xn--bcher-kva.test", "a。b．c｡test": "a.b.c.test", "１.２.３.４": "1.2.3.4",
    "ｅｘ.test": "ex.test", "so­ft.test": "soft.test", "é" * 64 + ".test": None, "x" * 64 + ".é.test": "x" * 64 + ".xn--9ca.test", "é／.test": None, "­": None, "xn--bcher-kva.test": "xn--bcher-kva.test",
    "a.test": "a.test", "A.Test.": "a.test.", "localhost": "localhost", "0x7f.1": "127.0.0.1", "256.1.1.1": None, "é." * 2000 + "test": "xn--9ca." * 2000 + "test",
}


def test_names(evaluate):
    got = evaluate([(x,) for x in NAMES], "h string", valid(F.col("h")))
    assert dict(zip(NAMES, got, strict=True)) == NAMES


def test_ipv6(evaluate):
    rng = random.Random(9)
    texts = [
        "::", "::1", "1::", "0:0::1", "0:0:0:0:0:0:0:1", "1:0:0:2:0:0:0:3", "1:0:0:2:3:0:0:4", "2001:DB8::ff:00:42", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8",
        "1:2:3:4:5:6:1.2.3.4", "64:ff9b::192.0.2.33", "1::2::3", ":::", ":1", "1:", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", "12345::", "::1.2.3", "::1.2.3.256",
        "::01.2.3.4", "1.2.3.4", "::1.2.3.4:5", "g::", "", "0:1:0:1:0:1:0:1", "0:0:1:0:0:0:0:0",
    ]
    for _ in range(400):
        pieces = [rng.choice(["0", "0", "0000", format(rng.randrange(65536), "x"), format(rng.randrange(65536), "04X")]) for _ in range(8)]
        texts.append(":".join(pieces))
    got = evaluate([(f"[{t}]",) for t in texts], "h string", valid(F.col("h")))

    def plain(text):
        """Parsed by the standard library; runs of zeros left out as browsers do."""
        try:
            value = int(ipaddress.IPv6Address(text))
        except ValueError:
            return None
        pieces = [format(value >> 16 * (7 - i) & 0xFFFF, "x") for i in range(8)]
        runs = [(e - s, -s) for s in range(8) for e in range(s + 2, 9) if set(pieces[s:e]) == {"0"}]
        if not runs:
            return f"[{':'.join(pieces)}]"
        size, start = max(runs)
        return f"[{':'.join(pieces[:-start])}::{':'.join(pieces[-start + size :])}]"

    for text, result in zip(texts, got, strict=True):
        assert result == plain(text), text


def test_urls_with_such_hosts_compare(evaluate):
    pairs = [("http://BÜCHER.test/a", "http://xn--bcher-kva.test/a"), ("http://[0:0::1]/", "http://[::1]/"), ("http://[0:0::1]:80/x/", "http://[::1]/x"),
             ("http://１２７.1/", "http://127.0.0.1/"), ("http://[1::2::3]/", None), (f"http://{'é' * 70}.test/", None), ("http://u@é.test:8080", "http://u@xn--9ca.test:8080/")]
    assert evaluate([(a,) for a, _ in pairs], "u string", normalize_url("u")) == [b for _, b in pairs]
    assert evaluate([(a,) for a, _ in pairs], "u string", is_http_url("u")) == [b is not None for _, b in pairs]
