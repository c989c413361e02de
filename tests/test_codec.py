import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolake.functions import codec as c

A, B = "a" * 40, "b" * 40


def test_known_ids():
    assert c.object_id("blob", b"") == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    assert c.object_id("blob", b"hello\n") == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert c.object_id("blob", b"hello world") == "95d09f2b10159347eece71399a7e2e907ea3df4f"


def test_header():
    assert c.parse_header(c.serialize("blob", b"x\0y")) == ("blob", 3, b"x\0y")
    for bad in (b"blob", b"blob 3", b"blob\0 3", b"blob x\0"):
        with pytest.raises(c.FormatError):
            c.parse_header(bad)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400), st.binary(max_size=400), st.integers(0, 50))
def test_delta_round_trip(a, b, n):
    target = a[n:] + b + a[:n] * 3
    assert c.delta_apply(a, c.delta_create(a, target)) == target


def test_delta_long_copies_and_errors():
    base = bytes(range(256)) * 400
    delta = c.delta_create(base, base + base)
    assert c.delta_apply(base, delta) == base + base and len(delta) < 100
    assert c.delta_sizes(delta) == (len(base), 2 * len(base))
    copy64k = c.write_varint(len(base)) + c.write_varint(0x10000) + bytes([0x80])  # size 0 stands for 65536
    assert c.delta_apply(base, copy64k) == base[:0x10000]
    for bad in (c.write_varint(1) + c.write_varint(1), c.write_varint(len(base)) + c.write_varint(1) + b"\0", c.write_varint(len(base)) + c.write_varint(5) + b"\1a"):
        with pytest.raises(c.FormatError):
            c.delta_apply(base, bad)


@given(st.integers(1, 7), st.integers(0, 1 << 40))
def test_entry_headers(code, size):
    head = c.entry_header(code, size)
    assert c.read_entry_header(head, 0) == (code, size, len(head))


@given(st.integers(0, 1 << 40))
def test_offsets(n):
    assert c.read_offset(c.write_offset(n), 0) == (n, len(c.write_offset(n)))


def _pack(entries: list[bytes]) -> bytes:
    body = b"PACK" + (2).to_bytes(4, "big") + len(entries).to_bytes(4, "big") + b"".join(entries)
    return body + hashlib.sha1(body).digest()


def test_pack_round_trip_and_deltas():
    objects = [("blob", b"hello\n" * 40), ("tree", b""), ("commit", b"tree x"), ("tag", b"t")]
    assert [(k, b) for _, k, b in c.read_pack(c.write_pack(objects))] == objects
    assert list(c.read_pack(c.write_pack([]))) == []
    base, target = b"hello\n" * 40, b"hello\n" * 39 + b"bye\n"
    delta = c.delta_create(base, target)
    whole = c.entry_header(3, len(base)) + zlib.compress(base)
    by_offset = c.entry_header(c.OFS_DELTA, len(delta)) + c.write_offset(len(whole)) + zlib.compress(delta)
    by_name = c.entry_header(c.REF_DELTA, len(delta)) + bytes.fromhex(c.object_id("blob", base)) + zlib.compress(delta)
    for entries in ([whole, by_offset], [whole, by_name]):
        assert [b for _, _, b in c.read_pack(_pack(entries))] == [base, target]
    assert [b for _, _, b in c.read_pack(_pack([by_name]), lambda sha: ("blob", base))] == [target]
    with pytest.raises(c.FormatError, match="no base"):
        list(c.read_pack(_pack([by_name])))


def test_a_pack_is_read_without_holding_its_bodies():
    import random
    import tracemalloc

    body = random.Random(1).randbytes(100_000)
    pack = c.write_pack(("blob", bytes([i]) + body) for i in range(200))
    tracemalloc.start()
    assert sum(len(b) for _, _, b in c.read_pack(pack)) == 200 * 100_001
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2_000_000


def test_segments_and_packs_are_made_entry_by_entry():
    seen = []

    def objects():
        for i in range(5):
            seen.append(i)
            yield c.serialize("blob", b"x" * i) if i != 2 else b"none"

    entries = c.segment_entries(objects())
    next(entries)
    assert seen == [0] and len(list(entries)) == 3
    made = [c.pack_entry("blob", b"x" * i) for i in range(3)]
    assert b"".join(c.pack_pieces([x for e in made for x in e], 3)) == c.write_pack([("blob", b"x" * i) for i in range(3)])


def test_chains_of_deltas_in_a_pack():
    bodies = [b"hello\n" * 40 + b"%d" % i for i in range(6)]
    entries = [c.entry_header(3, len(bodies[0])) + zlib.compress(bodies[0])]
    for a, b in zip(bodies, bodies[1:4]):  # each by the one before it
        delta = c.delta_create(a, b)
        entries.append(c.entry_header(c.OFS_DELTA, len(delta)) + c.write_offset(len(entries[-1])) + zlib.compress(delta))
    for b in bodies[4:]:  # two by one name
        delta = c.delta_create(bodies[3], b)
        entries.append(c.entry_header(c.REF_DELTA, len(delta)) + bytes.fromhex(c.object_id("blob", bodies[3])) + zlib.compress(delta))
    assert [b for _, _, b in c.read_pack(_pack(entries))] == bodies


def test_pack_errors():
    good = c.write_pack([("blob", b"x")])
    for bad, why in ((good[:20], "short"), (b"JUNK" + good[4:], "signature"), (good[:-1] + bytes([good[-1] ^ 1]), "checksum")):
        with pytest.raises(c.FormatError, match=why):
            list(c.read_pack(bad))
    body = good[:4] + (3).to_bytes(4, "big") + good[8:-20]
    with pytest.raises(c.FormatError, match="version"):
        list(c.read_pack(body + hashlib.sha1(body).digest()))


def test_trees():
    entries = [("040000", "foo", A), ("100644", "foo.txt", B), ("100644", "a", A)]
    body = c.encode_tree(entries)
    assert [e[1] for e in c.parse_tree(body)] == ["a", "foo.txt", "foo"]  # a directory compares as foo/
    assert c.parse_tree(body)[2][0] == "40000" and c.parse_tree(c.encode_tree(entries, padded=True))[2][0] == "040000"
    assert c.parse_tree(body[:-1]) == c.parse_tree(body)[:2]
    assert c.parse_tree(b"") == []
    assert [e[1] for e in c.with_entry(entries, ("100644", "a", B))] == ["foo", "foo.txt", "a"] and len(entries) == 3


def test_framed_lines():
    data = c.pkt_line("one\n") + c.DELIM + c.pkt_line("two") + c.FLUSH + c.pkt_line("") + c.FLUSH
    assert c.pkt_sections(data) == [[b"one\n", b"two"], [b""]]
    assert c.pkt_sections(c.pkt_line("ok") + b"zzzzrest") == [[b"ok"]]
    assert c.pkt_sections(b"00ffshort") == [] and c.pkt_line("x") == b"0005x"
    with pytest.raises(c.FormatError):
        c.pkt_line(b"x" * 65520)


def test_refs():
    v1 = c.pkt_line("# service=git-upload-pack\n") + c.FLUSH + c.pkt_line(f"{A} HEAD\0multi_ack ofs-delta\n") + c.pkt_line(f"{B} refs/heads/x\n") + c.pkt_line("junk\n") + c.FLUSH
    refs = c.parse_refs_v1(v1)
    assert refs.refs == {"HEAD": A, "refs/heads/x": B} and refs.head == A and refs.capabilities == {"multi_ack", "ofs-delta"}
    greeting = c.pkt_line("version 2\n") + c.pkt_line("ls-refs=unborn\n") + c.pkt_line("fetch\n") + c.FLUSH
    assert c.is_v2(greeting) and not c.is_v2(v1)
    assert c.parse_capabilities_v2(c.pkt_sections(greeting)[0]) == {"version 2": [], "ls-refs": ["unborn"], "fetch": []}
    answer = c.pkt_line(f"{A} HEAD symref-target:refs/heads/x\n") + c.pkt_line(f"{A} refs/heads/x\n") + c.FLUSH
    assert c.parse_ls_refs(answer).refs == {"HEAD": A, "refs/heads/x": A}
    assert c.pkt_sections(c.ls_refs_request())[0][0] == b"command=ls-refs\n"
    assert f"want {A}".encode() in c.fetch_request(A) and f"want {A}".encode() in c.fetch_request(A, 2)
    with pytest.raises(c.FormatError):
        c.fetch_request("x")


def test_channels():
    v1 = c.pkt_line("NAK\n") + c.pkt_line(b"\2half") + c.pkt_line(b"\1PA") + c.pkt_line(b"\1CK") + c.pkt_line(b"\3oops") + c.FLUSH
    assert c.demux(v1) == c.Fetched(b"PACK", "half", "oops")
    assert c.demux(c.pkt_line(b"\1raw")) == c.Fetched(b"raw", "", "")
    assert c.demux(c.pkt_line("NAK\n") + c.pkt_line(b"PACK"), sideband=False).pack == b"PACK"
    v2 = c.pkt_line("acknowledgments\n") + c.FLUSH + c.pkt_line("packfile\n") + c.pkt_line(b"\1x") + c.FLUSH + c.pkt_line(b"\1y")
    assert c.demux(v2, 2).pack == b"x"


def test_push():
    body = c.push_request([(c.NULL_SHA, A, "refs/heads/x"), (A, B, "refs/heads/y")], b"PACK")
    lines = c.pkt_sections(body)[0]
    assert b"\0report-status" in lines[0] and b"\0" not in lines[1] and body.endswith(b"0000PACK")
    for bad in ([], [("x", A, "refs/x")], [(A, B, "heads/x")]):
        with pytest.raises(c.FormatError):
            c.push_request(bad, b"")
    answer = c.pkt_line(b"\1unpack ok\n") + c.pkt_line("ok refs/heads/x\n") + c.pkt_line("ng refs/heads/y not fast\n") + c.pkt_line("ng z\n") + c.FLUSH
    assert c.parse_push(answer) == (True, None, [("refs/heads/x", True, None), ("refs/heads/y", False, "not fast"), ("z", False, None)])
    assert c.parse_push(c.pkt_line("unpack bad\n"))[:2] == (False, "bad")


def test_commits():
    body = c.encode_commit(A, [B], ("Al", "al@x", 5), "subject\n\nbody")
    assert body.decode() == f"tree {A}\nparent {B}\nauthor Al <al@x> 5 +0000\ncommitter Al <al@x> 5 +0000\n\nsubject\n\nbody"
    assert c.commit_tree(body) == A
    with pytest.raises(c.FormatError):
        c.encode_commit("x", [], ("a", "b", 1), "m")
    with pytest.raises(c.FormatError):
        c.commit_tree(b"parent x")


def test_segments_skip_what_is_no_object():
    data, n = c.segment([c.serialize("blob", b"x"), b"junk", c.serialize("odd", b"")])
    assert n == 1 and c.read_entry_header(data, 0)[:2] == (3, 1)


def test_inflate_reports_what_it_used():
    z = zlib.compress(b"abc", 0)
    assert c.inflate(z + b"tail") == (b"abc", len(z)) and c.inflate(zlib.compress(b""))[0] == b""
    for bad in (b"junk", z[:-3]):
        with pytest.raises(c.FormatError):
            c.inflate(bad)


def test_auth():
    assert c.auth_header("t") == "Basic eDp0"


def test_reading_a_pack_takes_time_in_proportion_to_it():
    import random
    import time

    r = random.Random(4)

    def seconds(n):
        pack = c.write_pack([("blob", r.randbytes(4000)) for _ in range(n)], 0)
        began = time.perf_counter()
        assert sum(1 for _ in c.read_pack(pack)) == n
        return time.perf_counter() - began

    few = min(seconds(1000) for _ in range(3))
    assert min(seconds(8000) for _ in range(2)) < 16 * few


def test_inflate_inside_other_bytes():
    for size in (0, 1, 5000, 3_000_000):
        body = bytes(range(256)) * (size // 256) + b"x" * (size % 256)
        packed = zlib.compress(body)
        assert c.inflate(b"head" + packed + b"tail" * 1000, 4) == (body, len(packed))
        with pytest.raises(c.FormatError):
            c.inflate(packed, 0, len(packed) - 1)
