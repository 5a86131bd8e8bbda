import gzip
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from sondera.llm import warc as wx


def records(n, seed=1):
    rng = random.Random(seed)
    return [({"WARC-Type": "response", "WARC-Record-ID": f"<urn:x:{k}>", "WARC-Target-URI": f"http://h/{k}"}, bytes(rng.randrange(256) for _ in range(rng.randrange(0, 400)))) for k in range(n)]


def read(data):
    rows = list(wx.salvage(data))
    got = [(x.headers["warc-record-id"], x.block) for x in rows if isinstance(x, wx.Record)]
    return got, [x for x in rows if isinstance(x, wx.Gap)], rows


def named(made):
    return [(h["WARC-Record-ID"], b) for h, b in made]


@pytest.mark.parametrize("form", ["plain", "gzip", "one member", "mixed"])
def test_round_trip(form):
    made = records(30)
    parts = [wx.record_bytes(h, b) for h, b in made]
    data = {"plain": b"".join(parts), "gzip": b"".join(map(wx.member, parts)), "one member": gzip.compress(b"".join(parts)), "mixed": b"".join(p if k % 2 else wx.member(p) for k, p in enumerate(parts))}[form]
    got, gaps, _ = read(data)
    assert got == named(made) and not gaps
    assert read(memoryview(data).tobytes())[0] == got


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("harm", ["flip", "cut", "junk", "zeros"])
def test_only_the_damaged_record_is_lost(packed, harm):
    """Every single record of an archive is damaged in turn; all the others come back, and the gap covers what was lost."""
    made = records(8, 5)
    parts = [(wx.member if packed else bytes)(wx.record_bytes(h, b + b"tail of the block")) for h, b in made]
    for k in range(len(parts)):
        own = bytearray(parts[k])
        middle = len(own) - 20 if not packed else len(own) // 2
        if harm == "flip":
            own[middle] ^= 0x10
        elif harm == "cut":
            del own[middle:]
        elif harm == "zeros":
            own[:] = bytes(len(own))
        else:
            own[:0] = b"\x1f\x8b\x08junk WARC/1.0\r\nWARC-"
        data = b"".join([*parts[:k], bytes(own), *parts[k + 1 :]])
        got, gaps, rows = read(data)
        want = [i for j, (i, _) in enumerate(named(made)) if j != k or harm == "junk"]
        assert [i for i, _ in got] == want
        assert len(gaps) == 1 and gaps[0].offset == sum(map(len, parts[:k]))
        assert gaps[0].length == (len(own) - len(parts[k]) if harm == "junk" else len(own)) and gaps[0].reason


def test_wrong_digest_and_wrong_length():
    made = records(3)
    parts = [wx.record_bytes(h, b + b"xyz") for h, b in made]
    for old, new, why in ((b"sha1:", b"sha1:AAAA", "digest"), (b"\r\nContent-Length: ", b"\r\nContent-Length: 9", "length"), (b"\r\nContent-Length: ", b"\r\nContent-Size: ", "length"), (b"WARC-Record-ID", b"WARC-Record", "headers")):
        data = parts[0] + parts[1].replace(old, new, 1) + parts[2]
        got, gaps, _ = read(data)
        assert [i for i, _ in got] == ["<urn:x:0>", "<urn:x:2>"] and [g.reason for g in gaps] == [why]


@settings(max_examples=150, deadline=None)
@given(hs.binary(max_size=300), hs.integers(0, 2000), hs.integers(0, 60))
def test_rows_cover_any_archive(junk, at, cut):
    """Whatever is put in or taken out: records and gaps are in order and cover the archive without an overlap."""
    parts = b"".join(wx.member(wx.record_bytes(h, b)) if k % 2 else wx.record_bytes(h, b) for k, (h, b) in enumerate(records(5, 9)))
    at = min(at, len(parts))
    data = parts[:at] + junk + parts[at + cut :]
    ends = 0
    for offset, length in sorted({(x.offset, x.length) for x in wx.salvage(data)}):
        assert offset == ends and length > 0
        ends = offset + length
    assert ends == len(data)
    known = {b for _, b in records(5, 9)}  # what stands in a header has no check sum; a block has
    assert {b for _, b in read(data)[0]} <= known


def test_tables_and_files(spark, tmp_path):
    made = records(12)
    data = b"".join(wx.member(wx.record_bytes(h, b)) for h, b in made)
    broken = data[:200] + b"?" * 50 + data[250:]
    rows = [("a", data, "x"), ("b", broken, "x"), ("b", broken, "x"), (None, data, None), ("c", None, "x"), ("d", b"", "x"), ("e", b"no archive", "x")]
    out = wx.salvage_archives(spark.createDataFrame(rows, "path string, content binary, kind string")).collect()
    count = {}
    for r in out:
        count[r.archive, r.kind] = count.get((r.archive, r.kind), 0) + 1
    assert count["a", "record"] == 12 == count[None, "record"] and ("a", "gap") not in count
    assert count["b", "record"] % 2 == 0 and count["b", "gap"] == 2 and count["e", "gap"] == 1 and not any(a in ("c", "d") for a, _ in count)
    (tmp_path / "x.warc.gz").write_bytes(broken)
    (tmp_path / "empty.warc").write_bytes(b"")
    files = spark.createDataFrame([(str(tmp_path / "x.warc.gz"),), ("file:" + str(tmp_path / "empty.warc"),), (None,)], "path string")
    assert wx.salvage_files(files).count() * 2 == count["b", "record"] + count["b", "gap"]
    assert wx.salvage_files(files.where("false")).count() == 0


def test_pages_come_back(spark):
    """All pages but those whose record is damaged beyond repair come back whole; the gaps are those pages' and the junk."""
    rng = random.Random(6)
    made = [(k, f"http://h/{k}", "".join(rng.choice("ab é<\n") for _ in range(rng.randrange(0, 900)))) for k in range(500)]
    out = wx.salvaged_pages(spark.createDataFrame(made, "page_id long, url string, html string")).collect()
    got = {r.page_id: (r.url, r.html) for r in out if r.kind == "record"}
    import hashlib

    kind = {k: hashlib.md5(u.encode()).digest()[0] for k, u, _ in made}
    lost = {k for k in kind if kind[k] in wx.FLIPPED or kind[k] in wx.CUT or kind[k] in wx.MISCOUNTED}
    assert got == {k: (u, h) for k, u, h in made if k not in lost} and lost
    gaps = [r for r in out if r.kind == "gap"]
    assert gaps and all(r.length > 0 and r.reason and r.page_id is None and r.html is None for r in gaps)
    odd = spark.createDataFrame([(None, None, None), (1, "u", "")], "page_id long, url string, html string")
    assert wx.salvaged_pages(odd).count() >= 1 and wx.salvaged_pages(odd.where("false")).count() == 0


@pytest.mark.parametrize("level", [0, 1, 9])
@pytest.mark.parametrize("harm", ["digest", "length", "headers", "stray"])
def test_one_bad_record_of_a_whole_member(harm, level):
    """Every record of a member is damaged before it is compressed: the others come back, and the gap says where in the inflated bytes."""
    made = records(6, 7)
    parts = [wx.record_bytes(h, b + b"xyz") for h, b in made]
    old, new = {"digest": (b"sha1:", b"sha1:AAAA"), "length": (b"\r\nContent-Length: ", b"\r\nContent-Length: 9"), "headers": (b"WARC-Record-ID", b"WARC-Record"), "stray": (b"WARC/1.0", b"stray bytes\r\nWARC/1.0")}[harm]
    for k in range(6):
        bad = parts[k].replace(old, new, 1)
        inner = wx.member(b"".join([*parts[:k], bad, *parts[k + 1 :]]), level)
        data = wx.member(parts[0]) + inner + parts[1]
        got, gaps, rows = read(data)
        assert [i for i, _ in got] == ["<urn:x:0>", *(i for j, (i, _) in enumerate(named(made)) if j != k or harm == "stray"), "<urn:x:1>"]
        at = sum(map(len, parts[:k]))
        assert [g.inside for g in gaps] == [(at, len(bad) - len(parts[k]) if harm == "stray" else len(bad))]
        assert all((x.offset, x.length) == (len(wx.member(parts[0])), len(inner)) for x in rows[1:-1]) and not any(x.reason for x in rows if isinstance(x, wx.Record))


@pytest.mark.parametrize("level", [0, 1, 9])
@pytest.mark.parametrize("last", [False, True])
def test_a_truncated_member_gives_what_inflated(last, level):
    made = records(9, 8)
    parts = [wx.record_bytes(h, b) for h, b in made]
    first, inner = wx.member(parts[0]), wx.member(b"".join(parts[1:7]), level)
    tail = b"" if last else wx.member(parts[7]) + parts[8]
    for cut in (len(inner) - 1, len(inner) - 8, len(inner) * 3 // 4, len(inner) // 2):
        got, gaps, rows = read(first + inner[:cut] + tail)
        ids = [i for i, _ in got]
        whole = [i for i, _ in named(made)][1:7]
        n = len([i for i in ids if i in whole])
        assert ids == ["<urn:x:0>", *whole[:n], *(() if last else ("<urn:x:7>", "<urn:x:8>"))]
        assert n >= (6 if cut >= len(inner) - 8 else 2) and got[1 : n + 1] == named(made)[1 : n + 1]
        assert gaps and all((x.offset, x.length) == (len(first), cut) for x in rows[1 : len(rows) - 2 * (not last)] if level)


def test_a_member_with_a_bad_check_sum():
    """Records whose digest holds come back with the reason; one without a digest can't be told from a damaged one."""
    made = records(4, 9)
    parts = [wx.record_bytes(h, b) for h, b in made]
    bare = parts[2].replace(b"WARC-Block-Digest", b"X-Digest")
    inner = bytearray(wx.member(b"".join([*parts[:2], bare, parts[3]])))
    inner[-6] ^= 1
    got, gaps, rows = read(bytes(inner) + parts[1])
    assert [i for i, _ in got] == ["<urn:x:0>", "<urn:x:1>", "<urn:x:3>", "<urn:x:1>"]
    assert [g.reason for g in gaps] == ["gzip", "gzip"] and gaps[0].inside == (len(parts[0] + parts[1]), len(bare))
    assert [x.reason for x in rows if isinstance(x, wx.Record)] == ["gzip", "gzip", "gzip", ""]


def test_rows_say_where_in_a_member(spark):
    parts = [wx.record_bytes(h, b) for h, b in records(3)]
    data = wx.member(parts[0] + b"stray" + parts[1]) + wx.member(parts[2])
    out = wx.salvage_archives(spark.createDataFrame([("a", data)], "path string, content binary")).collect()
    assert [r.record_id for r in out if r.kind == "record"] == ["<urn:x:0>", "<urn:x:1>", "<urn:x:2>"]
    assert [r.reason for r in out if r.kind == "gap"] == [f"version, inflated bytes {len(parts[0])} to {len(parts[0]) + 5}"]


@pytest.mark.parametrize("form", ["hex", "HEX", "base32", "bare base32"])
@pytest.mark.parametrize("kind", ["sha1", "SHA-1", "md5", "sha-256", "sha512", "sha3_256"])
def test_digests_of_any_form(kind, form):
    import base64
    import hashlib

    headers, block = records(1)[0]
    block += b"xyz"
    digest = hashlib.new({"SHA-1": "sha1", "sha-256": "sha256"}.get(kind, kind), block).digest()
    value = {"hex": digest.hex(), "HEX": digest.hex().upper(), "base32": base64.b32encode(digest).decode(), "bare base32": base64.b32encode(digest).decode().rstrip("=")}[form]
    plain = wx.record_bytes(headers, block)
    start = plain.index(b"sha1:")
    data = plain[:start] + f"{kind}:{value}".encode() + plain[plain.index(b"\r\n", start) :]
    assert read(data)[0] == [("<urn:x:0>", block)] and not read(data)[1]
    got, gaps, _ = read(data.replace(b"xyz\r\n\r\n", b"xyZ\r\n\r\n"))
    assert not got and [g.reason for g in gaps] == ["digest"]
    assert read(data.replace(f"{kind}:".encode(), b"crc-9:"))[0] == [("<urn:x:0>", block)]
