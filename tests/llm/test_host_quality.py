import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from pagelens.llm import host_quality as H


def plain_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é日\n\t\x0b\x1c\xa0#|"), max_size=80))
def test_counts_equal_brute_force(text):
    assert H.counts(text.encode()) == plain_counts(text)


def prose(k, n=60):
    return " ".join(f"word{(k * 7 + i * i) % 997}x{i}" for i in range(n))


def test_hosts_are_judged_together(spark):
    docs = [(i, "spam spam spam " * 30, "bad", "x") for i in range(95)] + [(95 + i, prose(i), "bad", "x") for i in range(5)]
    docs += [(200 + i, prose(i), f"good{i % 5}", "x") for i in range(300)] + [(600, "a b", "tiny", "x"), (601, prose(1), None, "x")]
    docs += [(None, None, "good1", "x"), (602, "", None, "x"), (602, "", None, "x"), (603, "w " * 200_000, "good2", "x"), (604, prose(2), "", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, host string")
    rows = H.host_quality(frame).collect()
    assert len(rows) == len(docs)
    by = {(r.doc_id): r for r in rows}
    for doc_id, text, _, _ in docs:
        r, want = by[doc_id], plain_counts(text) if len(text or "") < 10_000 else None
        assert want is None or tuple(r[c] for c in H.COUNTS) == want
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert not by[97].kept and not by[97].base_failed and not by[97].host_kept  # a clean document of a bad host
    assert by[201].kept and by[600].host_kept and not by[600].kept  # one failure doesn't condemn a host
    assert by[601].kept and by[604].kept and by[603].n_repeat_words == 200_000
    assert H.host_quality(frame.limit(0)).count() == 0


def judged(spark, hosts):
    """rate of each host, from (name, documents, failures), by the operator and by its SQL."""
    import duckdb

    frame = spark.createDataFrame(hosts, "host string, n long, failures long")
    rows = frame.selectExpr("host", "explode(sequence(1, n)) AS i", "failures").selectExpr("host", "i <= failures AS failed")
    rates = {r.host: r.rate for r in H.host_rates(rows).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE hosts (source VARCHAR, n BIGINT, failures BIGINT)")
    con.executemany("INSERT INTO hosts VALUES (?, ?, ?)", hosts)
    fit = H.SQL[H.SQL.index("fitted AS (") : H.SQL.index("bad AS (")].strip().rstrip(",")
    sql = f"WITH {fit} SELECT source, (failures + mean * weight) / (n + weight) FROM hosts, prior"
    assert {h: round(r, 9) for h, r in con.execute(sql).fetchall()} == {h: round(r, 9) for h, r in rates.items()}
    return rates


def test_a_hot_bad_host_does_not_condemn_clean_ones(spark):
    hosts = [("hot", 20_000, 18_000)] + [(f"bad{i}", 100, 100) for i in range(20)] + [(f"clean{i}", 5, 0) for i in range(2_000)]
    rates = judged(spark, hosts)
    assert all((rate > H.HOST_LIMIT) == (not host.startswith("clean")) for host, rate in rates.items())


def test_a_hot_bad_host_does_not_hide_bad_ones(spark):
    hosts = [("hot", 100_000, 90_000)] + [(f"bad{i}", n, n) for i, n in enumerate([20, 50, 300] * 33)]
    hosts += [(f"good{i}", 10, int(i % 2 == 0)) for i in range(9_900)]
    rates = judged(spark, hosts)
    assert all((rate > H.HOST_LIMIT) == (not host.startswith("good")) for host, rate in rates.items())


def test_few_or_single_documents_condemn_no_host(spark):
    assert max(judged(spark, [(f"h{i}", 1, int(i == 0)) for i in range(50)]).values()) < H.HOST_LIMIT
    assert judged(spark, [("a", 2, 2)] + [(f"h{i}", 9, 0) for i in range(50)])["a"] < H.HOST_LIMIT
