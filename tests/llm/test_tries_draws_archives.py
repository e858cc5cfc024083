"""Prefix tries, importance resampling and WARC archives against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import collections
import gzip
import hashlib
import io
import math
import random
import re
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import prefix_trie, resample, warc
from lorekeep.llm.common import shared_dir

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def turn_key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def trie(rows):
    """Nodes by brute force over all prefixes."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, turn_key(role or "", text or "")[:16], role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * (len(SPLIT.findall(k[-1][1])) if k else 0)
    return sorted((min(m), len(k), -1 if not k else min(members[k[:-1]]), len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


def chats():
    rng = random.Random(3)
    rows = []
    for c in range(-45, 120):
        shared = rng.choice([0, 0, 2, 6])
        n = rng.choice([1, 2, 3, 5, 9])
        rows += [(c, t if t != 1 else None, rng.choice(["user", None]) if t > shared else "user", f"same {t}" if t < shared else rng.choice(["a b", "a  b c", "", None, "é ü"])) for t in range(n)]
    rows += [(500 + i, t, "user", f"hot {t}") for i in range(40) for t in range(4)]  # one conversation, many copies
    rows += [(700 + i, t, "user", f"hot {t}" if t < 3 else f"own {i}") for i in range(40) for t in range(5)]
    rows += [(900, t, "user", f"long {t}") for t in range(300)] + [(901, t, "user", f"long {t}") for t in range(299)]
    rows += [(902, 1, "user", "x"), (902, 1, "user", "x"), (902, 1, "assistant", "x"), (None, 0, "user", "lost"), (None, None, None, None), (903, 0, "user", "word " * 50_000), (980, 0, "system", "only one"), (985, 0, "user", "gone")]
    return rows


@pytest.mark.parametrize("limit", [None, 20])
def test_prefix_trie(spark, limit):
    rows = chats()
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, d int").repartition(5)
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turns(d)), limit=limit)
    assert got.schema.simpleString() == "struct<conv_id:bigint,depth:bigint,parent_conv_id:bigint,n_convs:bigint,n_children:bigint,n_leaves:bigint,saved_tokens:bigint,ends_sha256:string>"
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got.collect()) == trie(rows)


def test_prefix_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    run = lambda rows, **k: [tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turns(spark.createDataFrame(rows, schema))), **k).collect()]
    assert run([]) == [] and run([(None, 1, "user", "x")]) == []
    # conversation 1 has h = 3 turns of conversation 0, which is not there, and none of its own after them: it ends at the root
    assert zlib.crc32(b"1") % 4 == 3
    assert run([(1, 0, "user", "x")]) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    assert sorted(run([(1, 0, "user", "x"), (5000, 0, "user", "y")], limit=1)) == sorted((a, b, None if c < 0 else c, *r) for a, b, c, *r in trie([(1, 0, "user", "x"), (5000, 0, "user", "y")]))


def test_ids_of_many_copies(monkeypatch, spark):
    """A digest of ids goes on over slices, batches and partitions."""
    monkeypatch.setattr(prefix_trie, "SLICE", 200)
    rows = [(20 * i, 0, "user", "same") for i in range(500)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = prefix_trie.prefix_trie(prefix_trie.turns(d)).where("depth = 1").collect()
    assert [(r.n_convs, r.ends_sha256) for r in got] == [(500, hashlib.sha256(",".join(str(20 * i) for i in range(500)).encode()).hexdigest())]
    batches = prefix_trie.turns(d).select(F.lit(b"k").alias("key"), "conv_id", "path").orderBy("conv_id").toArrow().to_batches(max_chunksize=37)
    sliced = [b for x in batches for b in prefix_trie.slice_ids(iter([x]))]
    assert len(sliced) > 13 and [b.column("ends")[0].as_py() for b in prefix_trie.join_slices(iter(sliced))] == [got[0].ends_sha256]


def drawn(rows, target, percent=10, n=1, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) by the definition."""

    def found(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return w + [" ".join(w[i : i + k]) for k in range(2, n + 1) for i in range(len(w) - k + 1)], len(w)

    bins = lambda fs: [zlib.crc32(f.encode()) % buckets for f in fs]
    s, t = collections.Counter(b for _, x in rows for b in bins(found(x)[0])), collections.Counter(b for x in target for b in bins(found(x)[0]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, x in rows:
        fs, words = found(x)
        weight = sum(map(gain, bins(fs))) // len(fs) if fs else 0
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))
        out.append((i, len(fs), weight, score, words))
    able = sorted((r for r in out if r[4] >= 20 and r[3] is not None), key=lambda r: (-r[3], *r[:3]))
    ranks = collections.defaultdict(list)
    for k, r in enumerate(able[: len(able) * percent // 100]):
        ranks[r].append(k + 1)
    return sorted(((*r[:4], ranks[r].pop() if ranks[r] else None) for r in out), key=repr)


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10_000, 10), (3, 50, 60), (1, 7, 0), (1, 7, 100)])
def test_resample(spark, n, buckets, percent):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(80)] + ["Été", "A1b", "x-y", "ÀB", "日本", "\x00z\x7f"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 19, 20, 21, 90])))) for i in range(300)]
    rows += [(7, rows[7][1])] * 40 + [(8, "another text of the same id " * 5), (None, "no id " * 30), (None, None), (900, None), (901, ""), (902, " .,; "), (903, "very long " * 200_000)]
    target = ["w1 w2 w3 w4 été", None, "", "w1 W1 日本"]
    d = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, score int, bin int").repartition(4)
    t = spark.createDataFrame([(x, 1) for x in target], "text string, item_id long")
    got = resample.resample(d, t, percent=percent, n=n, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == drawn(rows, target, percent, n, buckets)


def test_resample_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.resample(d, d).count() == 0
    assert [tuple(r)[:2] for r in resample.resample(one, d).collect()] == [(1, 3)]


def pages():
    big, small = "<p>" + "x" * 200, "<p>tiny"
    rows = [(i, f"http://a/{i}", f"<html>{i} é</html>" * 20) for i in range(50)]
    rows += [(100 + i, f"http://copy/{i}", big) for i in range(60)] + [(200 + i, "http://small", small) for i in range(5)]
    rows += [(300, None, None), (301, "http://a b\r\nWARC-Type: x%41", ""), (None, "http://none", big), (None, "http://none", "y" * 500), (None, "http://none", "y" * 500), (100, "http://again", big), (302, "u", "WARC/1.1\r\n\r\n" * 30), (303, "u", "é" * 50), (304, "v", "é" * 50), (305, "w", "日本" * 500_000)]
    return rows


def test_warc_round_trip(spark):
    rows = pages()
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(3)
    path = f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    warc.write_archives(d, path, roll=4000)
    got = warc.read_archives(spark, path).collect()
    first = {}
    for i, _, h in sorted(((i, u, h) for i, u, h in rows if i is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and (h or "") in first and first[h or ""] != i
        want.append((f"urn:page:{'' if i is None else i}", "revisit" if again else "response", u or "", f"urn:page:{first[h or '']}" if again else None, len(raw), hashlib.sha256(raw).hexdigest(), None if again else raw, None))
    shape = lambda r: (r.record_id, r.record_type, r.uri, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload), r.fault)
    assert sorted(map(shape, got), key=repr) == sorted(want, key=repr)
    assert warc.read_archives(spark, path, payload=False).where("payload is not null").count() == 0
    fs, root = warc.folder(path)
    archives = [f.path for f in fs.get_file_info(warc.pa.fs.FileSelector(root)) if f.path.endswith(".gz")]
    assert len(archives) > 3
    text = b"".join(gzip.decompress(fs.open_input_stream(a, compression=None).read()) for a in archives)  # any reader of gzip takes them
    assert text.count(b"WARC-Type: revisit") >= 60 and text.count(b"\r\nWARC-Record-ID: ") == len(rows)


def test_warc_no_pages(spark):
    path = f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def record(payload, page=1, **other):
    return warc.member({"record_id": f"urn:page:{page}", "record_type": "response", "uri": "u", "date": "d", "refers_to": None, "payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()} | other)


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_warc_faults(piece):
    """Broken members cost their own records only; the reader goes on with the next."""
    read = lambda data: [(r["record_id"], r["payload"], r["fault"]) for r in warc.read_archive(io.BytesIO(data), piece=piece)]
    good, last = record(b"one"), record(b"two" * 100, 2)
    fine = [("urn:page:1", b"one", None), ("urn:page:2", b"two" * 100, None)]
    assert read(good + last) == fine and read(b"") == []
    two_in_one = gzip.compress(gzip.decompress(good) + gzip.decompress(last))
    assert read(two_in_one) == fine
    assert read(record(b"one", payload_digest="0" * 64) + last) == [("urn:page:1", b"one", "payload digest differs"), fine[1]]
    plain = gzip.decompress(good)
    assert read(gzip.compress(plain.replace(b"one", b"eno")) + last)[0][2] == "block digest differs"
    short = re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\nContent-Length: 5\r\n\r\nHTTP", plain)
    assert read(gzip.compress(short) + last) == [(None, None, "record runs on after its block"), fine[1]]
    far = re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\nContent-Length: 5000\r\n\r\nHTTP", plain)
    assert read(gzip.compress(far) + last) == [(None, None, "block shorter than its Content-Length"), fine[1]]
    assert read(gzip.compress(b"hello") + last) == [(None, None, "header without end"), fine[1]]
    cut_off = read(good + last[:-9])
    assert cut_off[0] == fine[0] and "ends inside" in cut_off[-1][2]
    broken = bytearray(good)
    broken[40] ^= 0xFF
    assert read(bytes(broken) + last)[-1] == fine[1] and read(b"junk" + last)[-1] == fine[1]


def test_warc_foreign_records():
    """Digests in base32, folded header lines, records without HTTP."""
    import base64

    body = b"a body"
    sha1 = base64.b32encode(hashlib.sha1(body).digest())
    raw = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nWARC-Target-URI: http://x\r\n /y\r\nWARC-Block-Digest: sha1:%s\r\nContent-Type: text/plain\r\nContent-Length: 6\r\n\r\na body\r\n\r\n" % sha1
    (r,) = warc.read_archive(io.BytesIO(gzip.compress(raw)))
    assert (r["record_id"], r["record_type"], r["uri"], r["payload"], r["fault"]) == ("urn:x", "resource", "http://x /y", body, None)
    (r,) = warc.read_archive(io.BytesIO(gzip.compress(raw.replace(b"a body", b"b body"))))
    assert r["fault"] == "block digest differs"
