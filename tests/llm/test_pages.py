import hashlib

import duckdb
import pytest
from helpers import SF

from trustlens.llm import reputation, warc
from trustlens.llm.common import scratch

PAGES = [(1, "http://a/x", "p" * 120), (2, None, "p" * 120), (5, "http://a/\r\ny", "é" * 60), (3, "u", "é" * 60), (4, "", None), (6, "z", ""),
         (7, "z", "short"), (8, "z", "short"), (None, "n", "p" * 120), (9, "long", "<b>\r\n\r\nWARC/1.1</b>" * 40_000), (2, None, "p" * 120)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1, "r") for r in rows], "page_id long, url string, html string, payload long, record_type string")


def test_warc_query_equals_sql(spark):
    got = sorted(tuple(r) for r in warc.op8_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert got == sorted(con.execute(warc.ORACLE).fetchall())


def test_round_trip_of_odd_pages(spark):
    warc.register(spark)
    folder = scratch(spark, "warc")
    warc.archive_rows(pages(spark).repartition(3)).write.format("warc").mode("append").option("file_bytes", 1000).save(folder)
    rows = spark.read.format("warc").option("split_bytes", 2000).load(folder).collect()
    html = {i: h for i, _, h in PAGES}
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in rows), key=repr)
    assert kinds == sorted([(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (5, "revisit", 3), (4, "response", None),
                            (6, "response", None), (7, "response", None), (8, "response", None), (None, "revisit", 1), (9, "response", None)], key=repr)
    for r in rows:
        data = (html[r.page_id] or "").encode()
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha256(data).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data
    none = scratch(spark, "warc")
    warc.archive_rows(pages(spark, []).limit(0)).write.format("warc").mode("append").save(none)
    assert spark.read.format("warc").load(none).count() == 0


@pytest.mark.parametrize("where", ["record_type = 'revisit'", "page_id in (1, 9)", "target_uri like 'http%'", "payload_digest is null", "refers_to <=> 3",
                                   "payload_bytes > 100 and record_type = 'response'", "target_uri is not null and target_uri like '%z'"])
def test_pushed_predicates(spark, where):
    warc.register(spark)
    folder = scratch(spark, "warc")
    warc.archive_rows(pages(spark)).write.format("warc").mode("append").save(folder)
    df = spark.read.format("warc").load(folder)
    every = df.cache()
    assert sorted(map(repr, df.filter(where).select("page_id", "payload").collect())) == sorted(
        map(repr, spark.createDataFrame(every.collect(), every.schema).filter(where).select("page_id", "payload").collect()))
    every.unpersist()


def test_unwanted_payloads_are_not_read(tmp_path):
    path = str(tmp_path / "x.warc")
    rows = [{"page_id": i, "record_type": "response", "target_uri": "u", "payload_digest": "d", "payload_bytes": 500_000, "refers_to": None,
             "payload": b"x" * 500_000} for i in range(20)]
    open(path, "wb").write(b"".join(map(warc.encode, rows)))

    class Counting:
        def __init__(self, f):
            self.f, self.read = f, 0

        def size(self):
            return self.f.size()

        def read_at(self, n, at):
            self.read += n
            return self.f.read_at(n, at)

    import pyarrow.fs as fs
    file = Counting(fs.LocalFileSystem().open_input_file(path))
    got = list(warc.records(file, lambda r: r["page_id"] == 7, True))
    assert [r["page_id"] for r, _ in got] == [7] and got[0][1] == b"x" * 500_000
    assert file.read < 20 * (1 << 17) + 600_000


# ------------------------------------------------------------------ url filters

def rule_by_hand(host, path):
    best = None
    for verdict, h, p in reputation.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, verdict
    return best or (None, None)


def parts_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


URLS = [None, "", "no scheme", "http://", "http:///x", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/EN/", "x://net", "x://net/", "x://anet/",
        "a://b://c/d", "http://ÄB.org/fr/", "http://org/fr", "http://x.org?/fr/", "http://user@h.example.com:80/de/#f", "u://a.example.com/de"]


def test_rules_and_parts(spark):
    rows = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, n long")
    none = spark.createDataFrame([], "page_id long, bad int")
    for r in reputation.judged_urls(rows, none).collect():
        host, path = parts_by_hand(URLS[r.page_id])
        rule, verdict = rule_by_hand(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert reputation.judged_urls(rows.limit(0), none).count() == 0


def test_query_rules(spark):
    urls = dict(duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall())
    rows = reputation.op9_url_reputation(spark, SF).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = parts_by_hand(urls[r.page_id])
        rule, verdict = rule_by_hand(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(con.execute(reputation.oracle_sql()).fetchall())
    assert sorted(tuple(r) for r in reputation.op9_url_reputation(spark, SF).collect()) == want


def test_shrinkage(spark):
    """Bad hosts go with enough evidence, a single bad page is not enough, a bad domain condemns its hosts sooner."""
    urls, bad = [], []

    def add(host, outcomes):
        for b in outcomes:
            bad.append((len(urls), b))
            urls.append((len(urls), f"http://{host}/p{len(urls)}"))

    for i in range(40):
        add(f"good{i}.de", [0] * 30)
    add("spam.es", [1] * 60)
    add("once.fr", [1])
    for i in range(30):
        add(f"h{i}.farm.es", [1] * 20)
    add("new.farm.es", [1, 1])
    add("new.fine.de", [1, 1])
    rows = spark.createDataFrame(urls + [(10**6, "http://unseen.farm.es/"), (10**6 + 1, "http://unseen.de/")], "page_id long, url string")
    out = reputation.judged_urls(rows, spark.createDataFrame([*bad, (None, 1), (3, None)], "page_id long, bad int"))
    got = {r.host: r.verdict for r in out.collect()}
    assert got["spam.es"] == "block" and got["h3.farm.es"] == "block" and got["new.farm.es"] == "block"
    assert got["good1.de"] == got["once.fr"] == got["new.fine.de"] == got["unseen.de"] == "allow"
