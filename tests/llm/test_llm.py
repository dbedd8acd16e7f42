"""Each operator against a brute-force version, an exact round trip or held-out labels, and on odd tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from orbitlens.llm import classifier, ctw, decontaminate, jaccard, packing, secrets, substring, topk, urls, warc, words
from orbitlens.llm.components import components
from orbitlens.llm.queries import ORACLES, QUERIES
from tests.conftest import SF, canonical

R = np.random.default_rng(5)
VOCABULARY = [f"w{i}" for i in range(60)]
ODD = [(None, None), (1, ""), (2, " \t "), (2, "One two"), (3, "One two"), (None, "One two three four five"), (5, "é" * 50 + " x\x0by"), (6, "a b c d e " * 3000)]


def text(n, v=VOCABULARY):
    return " ".join(R.choice(v, n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "src", 1.5, "z") for i, t in rows], "doc_id long, text string, source string, score double, key string")


def near_copies():
    rows, base = [], text(120, [f"v{i}" for i in range(5000)])
    for i in range(40):
        w = base.split()
        for j in R.choice(len(w), i % 4, replace=False):
            w[j] = f"e{i}x{j}"
        rows.append((100 + i, " ".join(w)))
    return rows + [(i, text(int(R.integers(1, 90)))) for i in range(60)] + [(200, base), (201, base.upper())] + ODD


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def split(t, lower=True):
    b = (t or "").encode()
    return (b.lower() if lower else b).split()


def test_words_are_those_of_split():
    texts = [t for _, t in ODD] + ["A b", "ab", "x" * 700_000 + " y", "", "q"]
    hashes, first = words.words_of(pa.array(texts), True)
    seen = {}
    for i, t in enumerate(texts):
        own = split(t)
        assert first[i + 1] - first[i] == len(own)
        for w, h in zip(own, hashes[first[i] : first[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    pairs = [(int(a), int(b)) for a, b in R.integers(0, 120, (70, 2))] + [(500, i) for i in range(501, 540)] + [(i, i + 1) for i in range(600, 640)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard(spark, n, num):
    rows = near_copies()
    got = jaccard.ngram_jaccard_join(docs_of(spark, rows), n, num, 100).collect()
    sets = []
    for _, t in rows:
        w = split(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    want = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        want.append((doc, len(sets[i]), min(ids) if ids else None))
    key = lambda x: [(v is None, v or 0) for v in x]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("block", [512, 7])
def test_links_inside_components_are_counted(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "LINK_BLOCK", block)
    rows = near_copies()
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set()) for w in (split(t) for _, t in rows)]
    links = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
    want = collections.Counter((doc, len(sets[i]), sum(i in p for p in links)) for i, (doc, _) in enumerate(rows))
    docs = docs_of(spark, rows)
    assert collections.Counter((r.doc_id, r.n_shingles, r.n_links) for r in jaccard.link_counts(docs).collect()) == want
    members, pairs = (x.collect() for x in jaccard.jaccard_links(docs))
    by_node = collections.defaultdict(list)
    for r in members:
        by_node[r.node].append(r.doc_id)
    got = [p for node, x in by_node.items() if node is not None for p in itertools.combinations(x, 2)] + [(x, y) for r in pairs for x in by_node[r.a] for y in by_node[r.b]]
    ends = lambda pairs: collections.Counter(frozenset(p) for p in pairs)
    assert ends(got) == ends((rows[a][0], rows[b][0]) for a, b in links) and len(pairs) > 40


def test_keep_one_keeps_columns_and_one_row(spark):
    rows = near_copies() + [(300, "same words here again and again"), (300, "same words here again and again")]
    docs = docs_of(spark, rows)
    out = jaccard.keep_one(docs, 5, 80, 100)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(300) == 1 and 100 in ids and not {200, 201} & set(ids)


@pytest.mark.parametrize("window", [6, 50])
def test_substring(spark, window):
    shared = [text(n, [f"s{i}" for i in range(400)]) for n in (7, 12, 49, 50, 51, 80, 200)]
    rows = [(i, " ".join(([text(int(R.integers(0, 30)))] + [shared[j] for j in R.integers(0, 7, int(R.integers(0, 4)))] + [text(int(R.integers(0, 30)))]))) for i in range(40)] + ODD + [(7, shared[6]), (8, shared[6])]
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring.dedup_substrings(docs_of(spark, rows), window).collect())
    least = {}
    for doc, t in rows:
        w = split(t, False)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, math.inf), math.inf if doc is None else doc)
    want = collections.Counter()
    for doc, t in rows:
        w = split(t, False)
        gone = {j for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < (math.inf if doc is None else doc) for j in range(i, i + window)}
        want[doc, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    assert got == want


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def brute_ctw(train, texts, depth):
    """The tree as nested dictionaries, every probability by its definition."""
    counts = collections.defaultdict(lambda: [0, 0])

    def steps(t):
        s = b"\xff" * depth + t.encode().lower() + b"\xff"
        for p in range(depth, len(s)):
            for j in range(8):
                yield [(bytes(s[p - 1 : p - 1 - d if p - 1 - d >= 0 else None : -1]) if d else b"", j, s[p] >> (8 - j)) for d in range(depth + 1)], s[p] >> (7 - j) & 1

    for t in train:
        for nodes, bit in steps(t):
            for x in nodes:
                counts[x][bit] += 1
    kids = collections.defaultdict(list)
    for c, j, q in counts:
        if c:
            kids[c[:-1], j, q].append((c, j, q))
    memo = {}

    def weighted(x):
        if x not in memo:
            own = kt(*counts[x]) if x in counts else 0.0
            memo[x] = own if len(x[0]) == depth else np.logaddexp(own, sum(weighted(y) for y in kids.get(x, ()))) - math.log(2)
        return memo[x]

    out = []
    for t in texts:
        total = 0.0
        for nodes, bit in steps(t):
            p = None
            for x in reversed(nodes):
                a, b = counts.get(x, (0, 0))
                one = (b + 0.5) / (a + b + 1)
                if p is None:
                    p = one
                else:
                    eta = (kt(a, b) if a + b else 0.0) - sum(weighted(y) for y in kids.get(x, ()))
                    w = 1 / (1 + math.exp(-eta)) if eta > -700 else 0.0
                    p = w * one + (1 - w) * p
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_ctw(spark):
    rows = [(i, text(int(R.integers(0, 12)), ["the", "Thing", "of", "öl", "x"])) for i in range(24)] + [(None, None), (30, ""), (30, "the of")]
    docs = spark.createDataFrame([(i, t, i is not None and i % 4 == 1) for i, t in rows], "doc_id long, text string, held_out boolean")
    got = {(r.doc_id, r.score): r for r in ctw.score_texts(docs, depth=3).collect()}
    train = [t or "" for i, t in rows if not (i is not None and i % 4 == 1)]
    want = brute_ctw(train, [t or "" for _, t in rows], 3)
    c = collections.Counter(w for t in train for w in [*split(t), None])
    n, v = sum(c.values()), len(c)
    for (doc, t), score in zip(rows, want, strict=True):
        best = min((r for (d, _), r in got.items() if d == doc), key=lambda r: abs(r.score - score))
        assert best.score == pytest.approx(score, rel=1e-5)
        own = [*split(t), None]
        assert (best.n_tokens, best.n_known, best.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        assert best.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))


def test_topk(spark):
    x = R.normal(size=(300, 20)) * 3
    x[50:90] = x[7]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [None] * 20), (902, [math.nan] * 20), (903, [1.0, 2.0]), (None, [0.0] * 20), (950, []), (955, [1e30] * 20)]
    got = sorted(tuple(r) for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 10 = 0").collect())
    ints = {i: [int(np.floor(256 * v)) for v in r] for i, r in [*rows[:300], rows[-1]]}
    held = lambda v: max(-(2**63), min(2**63 - 1, v))
    want = []
    for q in range(0, 300, 10):
        scores = sorted((-held(sum(a * b for a, b in zip(ints[q], ints[c], strict=True))), c) for c in ints if c != q)[:5]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(scores, 1)]
    assert [x for x in got if x[0] < 300] == want


def test_topk_of_queries_that_share_an_id(spark):
    rows = [(0, [2.0, 0.0]), (0, [1.0, 5.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0])]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0").collect()
    assert [(r.vec_id, r.score) for r in sorted(got)] == [(1, 6 * 256 * 256), (2, 3 * 256 * 256)]


@pytest.mark.parametrize("tasks", [1, 4])
def test_topk_keeps_repeated_candidates(spark, tasks):
    rows = [(0, [1.0, 0.0])] + [(1, [9.0, 0.0])] * 2 + [(2, [8.0, 0.0])] * 6 + [(i, [float(8 - i), 1.0]) for i in range(3, 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(tasks)
    got = sorted((r.rank, r.vec_id) for r in topk.exact_top_k(vectors, "vec_id = 0").collect())
    assert got == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 2)]


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = [(i, text(int(R.integers(0, 900)))) for i in range(40)] + ODD + [(70, "日本語 <|endoftext|> naïve x"), (71, "a  b\n\n c\t'll 12³")]
    got = packing.pack_documents(docs_of(spark, rows)).toPandas()
    want = collections.Counter()
    for doc, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for i, (start, n) in enumerate(packing.cut(len(ids), 1024)):
            want[doc, i, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    mine = collections.Counter((None if x.doc_id != x.doc_id else int(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in got.itertuples())
    assert mine == want
    for _, g in got.groupby("sequence_id"):
        end = 0
        for x in g.sort_values("offset").itertuples():
            assert x.offset == end
            end += x.length
        assert end <= 1024
    assert got["sequence_id"].nunique() <= 1.1 * got["length"].sum() / 1024 + 2


def brute_secrets(t):
    out = []
    for order, (kind, pattern, least, group) in enumerate((("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2), ("access", "AKIA[A-Z0-9]+", 16, 0), ("hex", "[0-9a-f]+", 32, 0))):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t) if len(m[group]) >= least]
    return ",".join(x for _, _, x in sorted(out))


SECRETS = ["Password: 'hunter2hunter2'", "token=short", "API_KEY = abcdefgh", "apikey:secret=abcdefgh", "AKIA" + "A1" * 8, "AKIAX", "0" * 31, "é😀 " + "ab12" * 9, "token=abc token = " + "0f" * 20, "", None, "ſecret=abcdefgh", "secret\n:abcdefghi"]


def test_secrets(spark):
    rows = list(enumerate(SECRETS)) + ODD
    found = secrets.scan_secrets(docs_of(spark, rows)).collect()
    base = ["assign", "access", "hex"]
    got = collections.Counter((r.doc_id, ",".join(f"{base[x.kind]}:{x.start}:{x.end}" for x in r.found if x.kind < 3)) for r in found)
    assert got == collections.Counter((i, brute_secrets(t or "")) for i, t in rows)
    docs = docs_of(spark, rows)
    clean = secrets.redact_secrets(docs)
    assert clean.columns == docs.columns
    again = secrets.scan_secrets(clean).collect()
    assert len(again) == len(rows) and not any(r.found for r in again)


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{32,}") == []
    assert secrets.trigram_query("AKIA[A-Z0-9]{12,}") == [[frozenset({"AKI", "KIA"})]]
    rule = secrets.BASE_RULES[0]
    for word in ("password", "PASSWD", "Secret", "tOken", "api_key", "apikey"):
        low = word.lower()
        assert all(any(all(g in low for g in o) for o in clause) for clause in secrets.trigram_query(rule.pattern, True))


def test_warc_round_trip(spark):
    page = "<html>é" + "x" * 1200
    rows = [(1, "http://a/1", page), (2, "http://a/2\r\nEvil: 1", page), (9, None, page), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", page), (6, "u", "y" * 300_000)]
    path = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.record_id: r for r in warc.read_archive(spark, path).collect()}
    assert len(got) == 8 and got["urn:page:9"].record_type == "response" and bytes(got["urn:page:9"].payload) == page.encode()
    for i in ("1", "2", "none"):
        r = got[f"urn:page:{i}"]
        assert (r.record_type, r.refers_to, r.payload, r.payload_bytes, r.payload_digest) == ("revisit", "urn:page:9", None, len(page.encode()), hashlib.sha1(page.encode()).hexdigest())
    assert bytes(got["urn:page:6"].payload) == b"y" * 300_000 and got["urn:page:5"].payload_bytes == 0 and got["urn:page:9"].target_uri is None
    only = warc.read_archive(spark, path, payloads=False).where("record_type = 'response'")
    assert only.count() == 5 and all(r.payload is None for r in only.collect())


def foreign(path, zipped):
    """A hand-made archive without skip lengths: a plain file, one member a record, or one member for all."""
    import gzip

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    heads = [("warcinfo", "a", "application/warc-fields", b"software: x\r\n"), ("response", "b", "application/http; msgtype=response", http + b"<html>one\r\n\r\ntwo"), (None, "c", "text/plain", b"no type"), ("revisit", "d", "application/http", b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n"), ("response", "e", "application/http", http + b"y" * 200_000)]
    records = []
    for kind, i, content, body in heads:
        top = [b"WARC/1.0", *([f"WARC-Type: {kind}".encode()] if kind else []), f"WARC-Record-ID: <urn:{i}>".encode(), f"Content-Type: {content}".encode(), f"Content-Length: {len(body)}".encode()]
        records.append(b"\r\n".join(top) + b"\r\n\r\n" + body + b"\r\n\r\n")
    data = {"plain": b"".join(records), "records": b"".join(map(gzip.compress, records)), "whole": gzip.compress(b"".join(records))}[zipped]
    (path / ("x.warc" if zipped == "plain" else "x.warc.gz")).write_bytes(data)


@pytest.mark.parametrize("zipped", ["plain", "records", "whole"])
def test_warc_of_other_makers(spark, tmp_path, zipped):
    foreign(tmp_path, zipped)
    (tmp_path / "notes.txt").write_text("no archive")
    got = {r.record_id: r for r in warc.read_archive(spark, str(tmp_path)).collect()}
    assert set(got) == {f"urn:{i}" for i in "abcde"}
    assert bytes(got["urn:b"].payload) == b"<html>one\r\n\r\ntwo" and got["urn:b"].payload_bytes == 16 and got["urn:c"].record_type is None
    assert (got["urn:d"].payload, got["urn:d"].payload_bytes) == (None, 77) and bytes(got["urn:e"].payload) == b"y" * 200_000
    typed = warc.read_archive(spark, str(tmp_path), payloads=False).where("record_type IS NOT NULL")
    assert sorted(r.record_id[-1] for r in typed.collect()) == ["a", "b", "d", "e"] and all(r.payload is None for r in typed.collect())
    assert warc.read_archive(spark, str(tmp_path)).where("record_type = 'response' AND record_id <> 'urn:b'").count() == 1


def test_warc_folders(spark, tmp_path):
    assert warc.read_archive(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="(?i)no such file|not found|does not exist"):
        warc.read_archive(spark, str(tmp_path / "missing")).count()


def brute_url(url, rules, vocabulary):
    """Host, path, rule, verdict and counts by their definitions, one url at a time."""
    url = url or ""
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = low(host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fits, default=(0, 0, None, None))
    found = [w for t, w in vocabulary.items() if re.search(f"(?<![a-z0-9A-Z]){re.escape(t)}(?![a-z0-9A-Z])", low(url))]
    return host, path, rule, verdict or ("block" if sum(found) > 0.999 else "allow"), sum(w >= 1 for w in found), sum(w < 1 for w in found)


URLS = [
    None, "", "x", "HTTP://A.Org?x#y", "http://www.example.org/es/x", "http://example.org/en/12", "http://xorg/", "http://a.com/fr/", "http://a.com/de/x?y", "http://x/casino-bet", "http://x/betting/alphabet", "http://x/bet?bet=poker",
    "a://b://c/d", "http://É.org/é", "://org/", "http://x.net/POKER/Slots", "http://a.com/fr", "http://x.net/line\nbreak/porn", "ſ://xxx",
]


@pytest.mark.parametrize(("rules", "vocabulary"), [(urls.RULES, urls.VOCABULARY), ((), urls.VOCABULARY), (urls.RULES, {}), ((("net", "/line", "allow"), ("x.net", "/l", "block")), {"poker": 0.4, "slots": 0.6, "é": 1.0})])
def test_urls(spark, rules, vocabulary):
    rows = [*enumerate(URLS), (None, "http://x/poker/slots"), (3, "x"), (3, "x")]
    pages = spark.createDataFrame([(i, u, "h", "z") for i, u in rows], "page_id long, url string, html string, host string")
    got = collections.Counter(tuple(r) for r in urls.filter_urls(pages, rules, vocabulary).collect())
    assert got == collections.Counter((i, *brute_url(u, rules, vocabulary)) for i, u in rows)
    assert urls.filter_urls(pages.where("false"), rules, vocabulary).count() == 0


def test_url_vocabulary_from_a_file(spark, tmp_path, monkeypatch):
    (tmp_path / "terms.csv").write_text("term,weight\nCasino,1\nbet,0.5\nBET,0.25\n,1\nzero,0\nnone,\n")
    assert urls.read_vocabulary(spark, str(tmp_path / "terms.csv")) == {"casino": 1.0, "bet": 0.5}
    monkeypatch.setattr(urls, "MOST_TERMS", 1)
    with pytest.raises(ValueError):
        urls.read_vocabulary(spark, str(tmp_path / "terms.csv"))


def brute_score(item, t):
    h = np.zeros((len(item) + 1, len(t) + 1))
    for i, a in enumerate(item):
        for j, b in enumerate(t):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a == b else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max() / (2 * len(item))


def test_decontamination(spark):
    items = [(i, text(30, [f"b{i}x{j}" for j in range(90)])) for i in range(8)] + [(50, ""), (51, None), (52, "tiny one")]
    held = []
    for i in range(40):
        w = items[i % 8][1].split()
        for j in R.choice(30, i // 4, replace=False):
            w[j] = f"z{i}"
        held.append((i, " ".join([text(20), *w, text(25)])))
    rows = held + [(100 + i, text(50)) for i in range(10)] + ODD + [(60, "say Tiny ONE now")]
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contamination(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for doc, t in held:
        item = split(items[doc % 8][1])
        want = brute_score(item, split(t))
        if want >= 0.6:
            assert got[doc, doc % 8] == pytest.approx(want)
    assert {d for d, _ in got} <= {*range(40), 60} and got[60, 52] == 1
    docs = docs_of(spark, rows)
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == docs.columns and left.count() == len(rows) - len({d for d, _ in got})


def leaks_of(spark, item, passages, copies):
    """Scores of the documents that hold the passages, `copies` of each, by passage; missing ones as 0."""
    rows = [(100 * i + k, " ".join([text(20), *w, text(20)])) for i in range(copies) for k, w in enumerate(passages)]
    got = {r.doc_id: r.score for r in decontaminate.contamination(docs_of(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    return [[got.get(100 * i + k, 0) for i in range(copies)] for k in range(len(passages))]


@pytest.mark.parametrize("copies", [1, 5, 50, 1000])
def test_decontamination_finds_edited_copies_in_any_number_of_documents(spark, copies):
    item = [f"b{j}" for j in range(30)]
    fifth = [f"z{j}" if j % 5 == 4 else w for j, w in enumerate(item)]
    some = [f"z{j}" if j in R.choice(30, 9, replace=False) else w for j, w in enumerate(item)]
    passages = [item, fifth, item[:16], item[15:], [w for j, w in enumerate(item) if j % 4], some]
    want = [brute_score(item, w) for w in passages]
    assert min(want[:5]) >= 0.5
    for score, got in zip(want, leaks_of(spark, item, passages, copies), strict=True):
        assert got == pytest.approx([score if score >= 0.5 else 0] * copies)


def test_decontamination_finds_copies_without_a_long_run_of_words(spark):
    item = [f"b{j}" for j in range(32)]
    changed = [[f"z{j}" if j % 4 == at else w for j, w in enumerate(item)] for at in range(4)]
    between = [x for j, w in enumerate(item) for x in (w, f"z{j}")][:-1]
    third = [f"z{j}" if j % 3 == 2 else w for j, w in enumerate(item)]
    want = [brute_score(item, w) for w in [*changed, between, third]]
    assert min(want) >= 0.5
    assert [x for x, in leaks_of(spark, item, [*changed, between, third], 1)] == pytest.approx(want)


def test_classifier_on_held_out_labels(spark):
    got = classifier.op10_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    own = got.merge(labels, on="doc_id")
    own = own[own["held_out"]]
    assert (own["predicted"] == own["quality"]).mean() > 0.95
    net = classifier.Network()
    odd = docs_of(spark, ODD)
    assert classifier.classify(odd, net).count() == len(ODD) and classifier.keep_good(odd, net, 0.0).columns == odd.columns
    long = "word " * 1_200_000
    assert 0 <= net.score(pa.array([long, "", None]))[0] <= 1


def loop_score(net, raw):
    """The network's probability for one text's bytes, chunk by chunk, place by place, byte by byte."""
    bests, at = [], 0
    while True:
        chunk = raw[at : at + classifier.CHUNK]
        row = np.frombuffer(chunk.ljust(classifier.CHUNK, b"\xff"), np.uint8)
        seen, marks = {}, []
        for i in range(classifier.CHUNK):
            run = bytes(row[i : i + 4]) if i <= classifier.CHUNK - 4 else i
            back = i - seen[run] if run in seen else 0
            marks.append(0 if not back or i >= len(chunk) else 1 if back <= 32 else 2 if back <= 192 else 3)
            seen[run] = i
        symbol = row.astype(int) * 4 + np.array(marks)
        places = [sum(net.filters[k, symbol[p + k]] for k in range(classifier.WIDTH)) for p in range(classifier.CHUNK - classifier.WIDTH + 1)]
        bests.append(np.max(places, axis=0))
        at += classifier.STRIDE
        if at + classifier.CHUNK - classifier.STRIDE >= len(raw):
            break
    active = np.maximum(np.array(bests) + net.bias, 0)
    z = active.mean(0) @ net.mean + active.max(0) @ net.top + net.offset
    return 1 / (1 + math.exp(-z))


def test_classifier_by_loops():
    net = classifier.Network()
    net.bias += R.normal(size=len(net.bias)).astype(np.float32) * 0.1
    texts = ["", "a", text(30), "same same " * 60, "é" * 700, text(900), "x" * 1024, "y" * 1025, None]
    want = [loop_score(net, (t or "").encode()) for t in texts]
    assert net.score(pa.array(texts)) == pytest.approx(want, abs=1e-4)


def test_classifier_on_a_very_long_text():
    net, long = classifier.Network(), "some words " * 420_000 + text(3000)
    assert len(long) > 1 << 22
    data, offsets = words.text_buffer(pa.array([long]))
    z = net.logits(*classifier.symbols(data, offsets))[0]
    assert net.score(pa.array([long]))[0] == pytest.approx(1 / (1 + math.exp(-float(z))), abs=1e-5)


def test_classifier_sample_is_bounded(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i}") for i in range(400)] + [(7, "z" * 300), (9, None), (None, "no id"), (401, "w" * 5000)]
    marks = [(i, i % 2) for i in range(402)] + [(3, None), (4, 1), (None, 1), (900, 1), (11, 5)]
    docs, labels = docs_of(spark, rows), spark.createDataFrame([(i, q, "x") for i, q in marks], "doc_id long, quality int, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    label = {i: max(q for d, q in marks if d == i and q in (0, 1)) for i, _ in marks if i is not None and not held(i)}
    order = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in label], "i long").select("i", F.xxhash64("i")).collect()}
    for most, limit in ((20, 1 << 20), (1000, 1 << 20), (50, 400)):
        want = collections.Counter()
        for q in (0, 1):
            used = 0
            for i in sorted((i for i in label if label[i] == q and any(d == i and len(t or "") <= limit // 2 for d, t in rows)), key=lambda i: (order[i], i))[:most]:
                own = min((t or "" for d, t in rows if d == i and len(t or "") <= limit // 2), key=len)
                if used + len(own) <= limit // 2:
                    want[own, q] += 1
                    used += len(own)
        texts, y, weights = classifier.sample(docs, labels, most, limit)
        assert collections.Counter(zip(texts, y.astype(int).tolist(), strict=True)) == want
        assert weights.sum() == pytest.approx(len(weights))
    assert classifier.sample(docs, labels.where("false"))[0] == [] and classifier.sample(docs.where("false"), labels)[0] == []
    assert classifier.classify(docs.where("false"), classifier.fit(docs, labels.where("false"))).count() == 0


def test_packing_needs_few_sequences(spark):
    """Plans of small sets of lengths against the least number of sequences, by search."""

    def least(lengths, capacity):
        best, order = len(lengths), sorted(lengths, reverse=True)

        def place(i, gaps):
            nonlocal best
            if len(gaps) >= best:
                return
            if i == len(order):
                best = len(gaps)
                return
            for g in set(gaps):
                if g >= order[i]:
                    rest = list(gaps)
                    rest.remove(g)
                    place(i + 1, [*rest, g - order[i]])
            place(i + 1, [*gaps, capacity - order[i]])

        place(0, [])
        return best

    for _ in range(60):
        lengths = R.integers(1, 31, int(R.integers(1, 9)))
        got = packing.plan(np.bincount(lengths, minlength=31), 30)["sequences"][0]
        assert least(lengths.tolist(), 30) <= got <= least(lengths.tolist(), 30) + 1


def test_packing_of_a_very_long_text():
    ids = packing.token_ids(packing.default_tokenizer())
    long = " ".join(f"word{i % 977} naïve" for i in range(130_000)) + "  end\n\n"
    assert len(long) > 1 << 20
    assert ids.encode([long])[0] == np.array(ids.tokenizer.encode(long, add_special_tokens=False).ids, "<u4").tobytes()


ALL_SECRETS = [(r.kind, re.compile(r.pattern, (re.I if r.any_case else 0) | re.A), r.group, r.least) for r in (*secrets.BASE_RULES, *secrets.MORE_RULES)]


def all_spans(t):
    return sorted((m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(ALL_SECRETS) for m in pattern.finditer(t) if len(m[group]) >= least)


def redacted(t):
    out, at = [], 0
    for a, _, b in all_spans(t):
        if a >= at:
            out += [t[at:a], secrets.MARK]
        at = max(at, b)
    return "".join([*out, t[at:]])


MORE_SECRETS = [
    "-----BEGIN RSA PRIVATE KEY----- x -----BEGIN PRIVATE KEY-----", "ghp_" + "aB3" * 12, "ghx_" + "a" * 36, "xoxb-12345-abcdefgh", "xoxb-1", "token=ghp_" + "a1" * 18, "secret: AKIA" + "Z" * 16 + " " + "0f" * 20,
    " ".join(f"token=abcdefgh{i} é" for i in range(3000)),
]


def test_all_kinds_of_secrets(spark):
    rows = list(enumerate([*SECRETS, *MORE_SECRETS])) + ODD
    found = secrets.scan_secrets(docs_of(spark, rows)).collect()
    got = collections.Counter((r.doc_id, tuple((x.start, x.kind, x.end) for x in r.found)) for r in found)
    assert got == collections.Counter((i, tuple(all_spans(t or ""))) for i, t in rows)
    clean = collections.Counter((r.doc_id, r.text) for r in secrets.redact_secrets(docs_of(spark, rows)).collect())
    assert clean == collections.Counter((i, None if t is None else redacted(t)) for i, t in rows)


def test_empty_tables(spark):
    docs = docs_of(spark, [(1, "x")]).where("doc_id = 2")
    assert jaccard.ngram_jaccard_join(docs).count() == 0
    assert substring.dedup_substrings(docs).count() == 0
    assert ctw.score_texts(docs.selectExpr("doc_id", "text", "false AS held_out")).count() == 0
    assert packing.pack_documents(docs).count() == 0
    assert secrets.scan_secrets(docs).count() == 0
    assert decontaminate.contamination(docs, docs.selectExpr("doc_id AS item_id", "text")).count() == 0
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), "true").count() == 0
    assert jaccard.keep_one(docs).count() == 0 and jaccard.link_counts(docs).count() == 0 and secrets.redact_secrets(docs).count() == 0
    assert decontaminate.drop_contaminated(docs, docs.selectExpr("doc_id AS item_id", "text")).count() == 0
    assert decontaminate.drop_contaminated(docs_of(spark, ODD), docs.selectExpr("doc_id AS item_id", "text")).count() == len(ODD)
    assert warc.read_archive(spark, warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 100 < out.select("doc_id").distinct().count() < 200


def test_pipeline_by_hand(spark, tmp_path):
    """Every stage by its definition, on a folder with copies, a benchmark passage, secrets, odd texts, nulls and clashing columns."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    source = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(5).collect()]
    rows = [(r.doc_id, " ".join((r.text or "").split()[:250])) for r in source]
    good = next(t for _, t in rows if len(t.split()) > 120)
    rows += [(1000, good), (1001, good + " and more"), (1002, f"{good} {items[0][1]}"), (1003, good.replace(good.split()[3], "password: hunter2hunter2", 1)), (1003, good), (None, good + " too"), *ODD]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.5, "z", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, component string, node int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    net = classifier.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    rows = [(i, t) for (i, t), p in zip(rows, net.score(pa.array([t for _, t in rows], pa.large_string())), strict=True) if p >= classifier.THRESHOLD]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (split(t) for _, t in rows)]
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    last = lambda i: math.inf if i is None else i
    first, kept = {}, []
    for k, (i, t) in enumerate(rows):
        if sets[k]:
            first[label[k]] = min(first.get(label[k], (math.inf, math.inf)), (last(i), k))
    alone = {(i, t or "") for k, (i, t) in enumerate(rows) if not sets[k]}
    chosen = [rows[k] for _, k in first.values()] + [next((j, t) for j, t in rows if (j, t or "") == x) for x in alone]
    passages = [split(t) for _, t in items]
    for i, t in chosen:
        w = np.array(split(t), object)
        hit = any(decontaminate.align(np.array(x, object), w)[0] >= decontaminate.THRESHOLD * 2 * len(x) for x in passages if len(w))
        if not hit:
            kept.append((i, redacted(t or "")))
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = collections.Counter()
    for i, t in kept:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        for n, (start, size) in enumerate(packing.cut(len(ids), 1024)):
            want[i, n, start, size, zlib.crc32(ids[start : start + size].tobytes())] += 1
    got = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert got == want and len(kept) > 15 and 1002 not in {i for i, _ in kept}
    spark.createDataFrame([], docs.schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
