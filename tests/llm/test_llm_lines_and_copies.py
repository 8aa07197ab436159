"""Line dedup, exact dedup, cuckoo filter, URL rules: against brute force and DuckDB on small tables."""

import hashlib
import random

from pyspark.sql import functions as F

from tabprobe.llm.cuckoo import CuckooFilter, LiveIndex
from tabprobe.llm.exact_dedup import digest_of, exact_dedup, update_index
from tabprobe.llm.line_dedup import dedup_lines
from tabprobe.llm.url_filter import host_rule, judge_urls, word_rule

BLANKS = " \t\n\x0b\x0c\r"


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def docs(spark, rows, extra="lines string, key string, n_dropped int"):
    return spark.createDataFrame([(*r, "x", None, 3) for r in rows], f"doc_id bigint, text string, {extra}")


TEXTS = [(1, "A shared line here\nown one\n\n A SHARED line here\t\nshort"), (2, "a shared line here \nshort\nÉtage commun à tous"),
         (3, None), (4, ""), (5, "étage commun à tous\nÉtage commun à tous\n\n"), (6, "short\nshort"), (None, "a shared line here\nnull id"),
         (7, "a shared line here"), (8, "x" * 30_000 + "\nown"), (9, "x" * 30_000), (9, "x" * 30_000)]


def test_lines_against_brute_force(spark):
    got = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["kept_text"]) for r in dedup_lines(docs(spark, TEXTS)).collect())
    holders = {}
    for i, t in TEXTS:
        for line in (t or "").split("\n"):
            key = fold(line.strip(BLANKS))
            if i is not None and len(key) >= 10:
                holders.setdefault(key, set()).add(i)
    want = []
    for i, t in TEXTS:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(h := holders.get(fold(x.strip(BLANKS)), ())) < 2 or min(h) == i]
        want.append((i or 0, len(lines), len(lines) - len(stay), "\n".join(stay)))
    assert got == sorted(want)
    assert dedup_lines(docs(spark, [])).count() == 0


def test_exact_copies_against_brute_force(spark):
    rows = [*TEXTS, (10, "OWN"), (11, "own"), (12, "oWn"), (13, "É"), (14, "é"), (None, ""), (None, "only null"), (4, "")]
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t or ""), []).append(i)
    want = []
    for i, t in rows:
        ids = groups[fold(t or "")]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i or 0, keep or 0, len(ids), i == keep, hashlib.sha256(fold(t or "").encode()).hexdigest()))
    got = [(r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(docs(spark, rows)).collect()]
    assert sorted(got) == sorted(want)
    assert exact_dedup(docs(spark, [])).count() == 0


def test_index_takes_withdrawals_and_later_batches(spark):
    def batch(*rows):
        return spark.createDataFrame(list(rows), "id bigint, text string").select("id", digest_of(F.col("text")).alias("digest"))

    first = update_index(None, batch((1, "a"), (2, "A"), (3, "b")))
    second = update_index(first, batch((9, "a"), (4, "c")), removed=batch((0, "b")).select("digest"))
    got = {bytes(r["digest"]): (r["keep_id"], r["size"]) for r in second.collect()}
    assert got == {hashlib.sha256(t.encode()).digest(): v for t, v in (("a", (9, 3)), ("c", (4, 1)))}


def test_cuckoo_filter_resizes_and_deletes():
    rng = random.Random(4)
    keys = [rng.randbytes(32) for _ in range(5000)]
    index = LiveIndex(n_buckets=4)
    for n, key in enumerate(keys):
        index.add(key, n, 1)
    assert index.resizes > 5 and all(index.find(k)[1] == n for n, k in enumerate(keys))
    assert all(index.find(rng.randbytes(32)) is None for _ in range(2000))
    assert all(index.remove(k) for k in keys[::2]) and not index.remove(keys[0])
    assert all((index.find(k) is None) == (n % 2 == 0) for n, k in enumerate(keys))
    twin = bytearray(keys[1])  # the same 64-bit key, another digest: a hit that verification rejects
    twin[-1] ^= 1
    assert index.find(bytes(twin)) is None and index.false_hits >= 1
    full = CuckooFilter(1, kicks=20)
    assert [full.insert(5 << 48) for _ in range(5)] == [True] * 4 + [False]


URLS = ["https://a.EXAMPLE.org/en/1?x=1", "https://example.org/en/2", "http://b.org/es/", "https://x.example.org/es/q#f", "https://notexample.org/es/",
        "https://a.com/fr/1", "https://a.com/de/1", "https://a.com", "https://a.org", "noscheme.org/es/", None, "", "https://ads.net/x", "https://uploads.net/x",
        "ftp://h?q=/org/", "https://casino.org/", "x://y://z.com/de/", "https://a.com/DE/1", "https://a.net/bets#x", "https://com/de/"]


def test_urls_against_all_rules(spark):
    import re

    from tabprobe.llm.url_filter import HOST_RULES, WORD_RULES

    pages = spark.createDataFrame([(n % 15, u, "h", n) for n, u in enumerate(URLS * 2)], "page_id bigint, url string, host string, tail int")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in judge_urls(pages).collect())
    want = []
    for n, u in enumerate(URLS * 2):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = fold(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        fits = [r for r in HOST_RULES for h, p in [r.name.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, key=lambda r: r.length, default=None)
        words = any(re.search(f"(?<![A-Za-z0-9]){r.name}(?![A-Za-z0-9])", host + rest[len(host):]) for r in WORD_RULES)
        want.append((n % 15, host, path, best.name if best else "", best.verdict if best else "block" if words else "allow"))
    assert got == sorted(want)
    assert judge_urls(pages.limit(0)).count() == 0


def test_rules_need_whole_tokens(spark):
    assert host_rule("block", "example.org", "/en/1").tokens == ("example", "org", "en") and word_rule("block", "a-b").tokens == ("a", "b")
    pages = spark.createDataFrame([(1, "https://e.org/en/12"), (2, "https://e.org/en/2")], "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in judge_urls(pages, rules=[host_rule("block", "e.org", "/en/1")]).collect()}
    assert got == {1: "block", 2: "allow"}
