"""Byte codecs of versioned object stores: loose objects, trees, deltas, packs, framed lines and their messages. No Spark here."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

# Fixed values of the formats.
PACK_CODE = {"commit": 1, "tree": 2, "blob": 3, "tag": 4}
PACK_TYPE = {v: k for k, v in PACK_CODE.items()}
OFS_DELTA, REF_DELTA = 6, 7
OBJECT_CODE = {"blob": 1, "tree": 2, "commit": 3, "tag": 4}
DIR_MODES = ("40000", "040000")
NULL_SHA = "0" * 40
FLUSH, DELIM, END = b"0000", b"0001", b"0002"
MAX_LINE = 65520


class FormatError(ValueError):
    """Bytes that break their format."""


# --- objects -------------------------------------------------------------------------------


def serialize(kind: str, body: bytes) -> bytes:
    return b"%b %d\0%b" % (kind.encode(), len(body), body)


def object_id(kind: str, body: bytes) -> str:
    return hashlib.sha1(serialize(kind, body)).hexdigest()


def parse_header(raw: bytes) -> tuple[str, int, bytes]:
    """(type, declared size, body)."""
    nul, space = raw.find(b"\0"), raw.find(b" ")
    if nul < 0 or space < 0 or space > nul:
        raise FormatError("malformed object header")
    size = raw[space + 1 : nul]
    if not size.isdigit():
        raise FormatError("malformed object size")
    return raw[:space].decode("utf-8", "replace"), int(size), raw[nul + 1 :]


def loose_encode(kind: str, body: bytes, level: int = 6) -> bytes:
    return zlib.compress(serialize(kind, body), level)


def inflate(data: bytes, at: int = 0, end: int | None = None) -> tuple[bytes, int]:
    """(content, compressed bytes that were used) of the stream that starts at a place of data.

    The stream is fed in pieces that grow with it, so what comes behind it costs nothing.
    """
    view = memoryview(data)[at:end]
    unpack, out, used, step = zlib.decompressobj(), [], 0, 1024
    try:
        while not unpack.eof and used < len(view):
            piece = view[used : used + step]
            out.append(unpack.decompress(piece))
            used += len(piece)
            step = min(2 * step, 1 << 20)
    except zlib.error as e:
        raise FormatError(f"inflate: {e}") from e
    if not unpack.eof:
        raise FormatError("inflate: the stream ends early")
    return b"".join(out), used - len(unpack.unused_data)


# --- trees ---------------------------------------------------------------------------------


def parse_tree(body: bytes) -> list[tuple[str, str, str]]:
    """(mode, name, sha) of each whole entry; stops at a rest that cannot hold one."""
    out, at = [], 0
    while at < len(body):
        space = body.find(b" ", at)
        nul = body.find(b"\0", space + 1) if space >= 0 else -1
        if space < 0 or nul < 0 or len(body) < nul + 21:
            break
        out.append((body[at:space].decode(), body[space + 1 : nul].decode("utf-8", "replace"), body[nul + 1 : nul + 21].hex()))
        at = nul + 21
    return out


def canonical_mode(mode: str, padded: bool = False) -> str:
    """Directories are 40000; padded writes 040000 as some tools do."""
    return ("040000" if padded else "40000") if mode in DIR_MODES else mode


def tree_order(mode: str, name: str) -> bytes:
    return name.encode() + (b"/" if mode in DIR_MODES else b"")


def encode_tree(entries: Iterable[tuple[str, str, str]], padded: bool = False) -> bytes:
    rows = sorted(entries, key=lambda e: tree_order(e[0], e[1]))
    return b"".join(b"%b %b\0%b" % (canonical_mode(m, padded).encode(), n.encode(), bytes.fromhex(s)) for m, n, s in rows)


def with_entry(entries: list, entry: tuple[str, str, str]) -> list:
    return [*without_entry(entries, entry[1]), entry]


def without_entry(entries: list, name: str) -> list:
    return [e for e in entries if e[1] != name]


# --- deltas --------------------------------------------------------------------------------


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data):
            raise FormatError("varint: the data end early")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if not b & 128:
            return value, at
        shift += 7


def write_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def delta_sizes(delta: bytes) -> tuple[int, int]:
    """(size of the base, size of the target)."""
    base, at = read_varint(delta, 0)
    return base, read_varint(delta, at)[0]


def delta_apply(base: bytes, delta: bytes) -> bytes:
    size, at = read_varint(delta, 0)
    target, at = read_varint(delta, at)
    if size != len(base):
        raise FormatError(f"delta: made for a base of {size} bytes, not {len(base)}")
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            offset = length = 0
            for bit in range(4):
                if op >> bit & 1:
                    offset |= delta[at] << 8 * bit
                    at += 1
            for bit in range(3):
                if op >> 4 + bit & 1:
                    length |= delta[at] << 8 * bit
                    at += 1
            length = length or 0x10000
            if offset + length > len(base):
                raise FormatError("delta: copy beyond the base")
            out += base[offset : offset + length]
        elif op:
            if at + op > len(delta):
                raise FormatError("delta: insert beyond the data")
            out += delta[at : at + op]
            at += op
        else:
            raise FormatError("delta: instruction 0")
    if len(out) != target:
        raise FormatError(f"delta: made {len(out)} bytes, not {target}")
    return bytes(out)


def delta_create(base: bytes, target: bytes, block: int = 16) -> bytes:
    """A delta from base to target: copies of blocks that base holds, extended both ways, and inserts between them."""
    at_base = {base[i : i + block]: i for i in range(len(base) - block, -1, -block)} if len(base) >= block else {}
    out = bytearray(write_varint(len(base)) + write_varint(len(target)))

    def insert(data: bytes) -> None:
        for i in range(0, len(data), 127):
            part = data[i : i + 127]
            out.append(len(part))
            out.extend(part)

    def copy(offset: int, length: int) -> None:
        while length:
            n = min(length, 0xFFFFFF)
            op, args = 128, bytearray()
            for bit in range(4):
                if b := offset >> 8 * bit & 255:
                    op |= 1 << bit
                    args.append(b)
            for bit in range(3):
                if n != 0x10000 and (b := n >> 8 * bit & 255):
                    op |= 16 << bit
                    args.append(b)
            out.append(op)
            out.extend(args)
            offset, length = offset + n, length - n

    done = at = 0
    while at + block <= len(target):
        source = at_base.get(target[at : at + block])
        if source is None:
            at += 1
            continue
        end, begin, b = at + block, at, source
        while begin > done and b and target[begin - 1] == base[b - 1]:
            begin, b = begin - 1, b - 1
        e = source + block
        while end < len(target) and e < len(base) and target[end] == base[e]:
            end, e = end + 1, e + 1
        insert(target[done:begin])
        copy(b, e - b)
        done = at = end
    insert(target[done:])
    return bytes(out)


# --- packs ---------------------------------------------------------------------------------


def entry_header(code: int, size: int) -> bytes:
    out, rest = bytearray([code << 4 | size & 15]), size >> 4
    while rest:
        out[-1] |= 128
        out.append(rest & 127)
        rest >>= 7
    return bytes(out)


def read_entry_header(data: bytes, at: int) -> tuple[int, int, int]:
    """(code, size, position after it)."""
    b = data[at]
    code, size, shift, at = b >> 4 & 7, b & 15, 4, at + 1
    while b & 128:
        b = data[at]
        size |= (b & 127) << shift
        shift, at = shift + 7, at + 1
    return code, size, at


def read_offset(data: bytes, at: int) -> tuple[int, int]:
    """(how far back a delta's base lies, position after it)."""
    b = data[at]
    value, at = b & 127, at + 1
    while b & 128:
        b = data[at]
        value, at = (value + 1 << 7) | b & 127, at + 1
    return value, at


def write_offset(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        n -= 1
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def pack_entry(kind: str, body: bytes, level: int = 6) -> list[bytes]:
    return [entry_header(PACK_CODE[kind], len(body)), zlib.compress(body, level)]


def pack_pieces(entries: list[bytes], count: int) -> Iterator[bytes]:
    """The bytes of a version 2 pack of so many entries, piece by piece."""
    digest = hashlib.sha1()
    for x in (b"PACK" + struct.pack(">II", 2, count), *entries):
        digest.update(x)
        yield x
    yield digest.digest()


def write_pack(objects: Iterable[tuple[str, bytes]], level: int = 6) -> bytes:
    """A version 2 pack of whole objects (type, body), in the given order."""
    entries = [pack_entry(kind, body, level) for kind, body in objects]
    return b"".join(pack_pieces([x for e in entries for x in e], len(entries)))


def _pack_entries(pack: bytes, count: int, end: int) -> Iterator[tuple[int, int, int | str | None, int, bytes]]:
    """(place, code, place or name of the base, size, inflated data) of each entry."""
    at = 12
    for _ in range(count):
        place, origin = at, None
        code, size, at = read_entry_header(pack, at)
        if code == OFS_DELTA:
            back, at = read_offset(pack, at)
            origin = place - back
        elif code == REF_DELTA:
            origin, at = pack[at : at + 20].hex(), at + 20
        elif code not in PACK_TYPE:
            raise FormatError(f"pack: entry type {code}")
        data, used = inflate(pack, at, end)
        at += used
        yield place, code, origin, size, data


def read_pack(pack: bytes, base: Callable[[str], tuple[str, bytes] | None] | None = None) -> Iterator[tuple[str, str, bytes]]:
    """(sha, type, body) of a pack's entries in order; base looks up the bases that the pack does not hold.

    A first pass finds what deltas are based on; only these bodies are held, until their last delta.
    """
    if len(pack) < 32:
        raise FormatError("pack: too short")
    if pack[:4] != b"PACK":
        raise FormatError("pack: bad signature")
    version, count = struct.unpack(">II", pack[4:12])
    if version != 2:
        raise FormatError(f"pack: version {version}")
    end = len(pack) - 20
    if hashlib.sha1(memoryview(pack)[:end]).digest() != pack[end:]:
        raise FormatError("pack: bad checksum")
    wanted = Counter(origin for _, _, origin, _, _ in _pack_entries(pack, count, end) if origin is not None)
    held: dict[int | str, tuple[str, bytes]] = {}
    for place, code, name, size, data in _pack_entries(pack, count, end):
        origin = None
        if name is not None:
            origin = held.get(name) or (base(name) if base and code == REF_DELTA else None)
            if origin is None:
                raise FormatError("pack: the base of a delta does not come before it" if code == OFS_DELTA else f"pack: no base {name}")
            wanted[name] -= 1
            if not wanted[name]:
                held.pop(name, None)
        if len(data) != size:
            raise FormatError("pack: an entry has another size than it says")
        kind, body = (origin[0], delta_apply(origin[1], data)) if origin else (PACK_TYPE[code], data)
        sha = object_id(kind, body)
        for x in (place, sha):
            if wanted.get(x):
                held[x] = kind, body
        yield sha, kind, body


def segment_entries(objects: Iterable[bytes], level: int = 6) -> Iterator[tuple[list[bytes], int]]:
    """(pack entry, size of the object) of raw objects with their header; what is no object is left out."""
    for raw in objects:
        try:
            kind, _, body = parse_header(raw)
            yield pack_entry(kind, body, level), len(raw)
        except (FormatError, KeyError):
            continue


def segment(objects: Iterable[bytes], level: int = 6) -> tuple[bytes, int]:
    """Pack entries (no header, no trailer) of raw objects with their header, and how many; what is no object is left out."""
    entries = [e for e, _ in segment_entries(objects, level)]
    return b"".join(x for e in entries for x in e), len(entries)


# --- framed lines --------------------------------------------------------------------------


def pkt_line(data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    if len(data) + 4 > MAX_LINE:
        raise FormatError("line too long")
    return b"%04x%b" % (len(data) + 4, data)


def pkt_lines(data: bytes) -> Iterator[bytes | None]:
    """Lines of a stream; None is a flush. Delimiters are passed over; ends at the first malformed length."""
    at = 0
    while at + 4 <= len(data):
        head = data[at : at + 4]
        if head == FLUSH:
            yield None
            at += 4
        elif head in (DELIM, END):
            at += 4
        else:
            if not re.fullmatch(rb"[0-9a-fA-F]{4}", head) or (size := int(head, 16)) < 4 or at + size > len(data):
                return
            yield data[at + 4 : at + size]
            at += size


def pkt_sections(data: bytes) -> list[list[bytes]]:
    out: list[list[bytes]] = [[]]
    for line in pkt_lines(data):
        if line is None:
            out.append([])
        else:
            out[-1].append(line)
    return out if out[-1] else out[:-1]


@dataclass
class Refs:
    refs: dict[str, str] = field(default_factory=dict)
    capabilities: set[str] = field(default_factory=set)
    head: str | None = None


def _text(line: bytes) -> str:
    return line.decode("utf-8", "replace").removesuffix("\n")


def _is_sha(x: str) -> bool:
    return bool(re.fullmatch("[0-9a-f]{40}", x))


def parse_refs_v1(data: bytes) -> Refs:
    sections = pkt_sections(data)
    lines = next((s for s in sections[1:2] if s), sections[0] if sections else [])
    out = Refs()
    for i, line in enumerate(lines):
        text, _, caps = _text(line).partition("\0") if i == 0 else (_text(line), "", "")
        sha, space, name = text.partition(" ")
        if not space or not _is_sha(sha):
            continue
        out.refs[name] = sha
        out.head = sha if name == "HEAD" else out.head
        out.capabilities.update(c for c in caps.split(" ") if c)
    return out


def parse_capabilities_v2(lines: Iterable[bytes]) -> dict[str, list[str]]:
    """Capabilities of a version 2 greeting with their values."""
    out = {}
    for line in lines:
        if text := _text(line):
            name, _, values = text.partition("=")
            out[name] = [v for v in values.split(" ") if v]
    return out


def is_v2(data: bytes) -> bool:
    return next((_text(s[0]) == "version 2" for s in pkt_sections(data) if s), False)


def ls_refs_request(agent: str = "chronolake") -> bytes:
    lines = ["command=ls-refs\n", f"agent={agent}\n", "object-format=sha1\n"]
    wanted = ["peel\n", "symrefs\n", "ref-prefix HEAD\n", "ref-prefix refs/heads/\n", "ref-prefix refs/tags/\n"]
    return b"".join(map(pkt_line, lines)) + DELIM + b"".join(map(pkt_line, wanted)) + FLUSH


def parse_ls_refs(data: bytes, capabilities: Iterable[str] = ()) -> Refs:
    out = Refs(capabilities=set(capabilities))
    for line in next((s for s in pkt_sections(data) if s), []):
        parts = _text(line).split(" ")
        if len(parts) >= 2 and _is_sha(parts[0]):
            out.refs[parts[1]] = parts[0]
            out.head = parts[0] if parts[1] == "HEAD" else out.head
    return out


def fetch_request(sha: str, version: int = 1, agent: str = "chronolake") -> bytes:
    if not _is_sha(sha):
        raise FormatError(f"not a sha: {sha}")
    if version == 1:
        return pkt_line(f"want {sha} side-band-64k ofs-delta agent={agent}\n") + FLUSH + pkt_line("done\n")
    lines = ["command=fetch\n", f"agent={agent}\n", "object-format=sha1\n"]
    return b"".join(map(pkt_line, lines)) + DELIM + b"".join(map(pkt_line, ["ofs-delta\n", f"want {sha}\n", "done\n"])) + FLUSH


@dataclass
class Fetched:
    pack: bytes
    progress: str
    errors: str


def demux(data: bytes, version: int = 1, sideband: bool = True) -> Fetched:
    """Splits a fetch response into its channels."""
    parts: dict[int, list[bytes]] = {1: [], 2: [], 3: []}
    begun = False
    for line in pkt_lines(data):
        if line is None:
            if version == 2 and begun:
                break
        elif version == 2 and not begun:
            begun = _text(line) == "packfile"
        elif version == 1 and not begun:
            begun = True
            if line[:3] not in (b"ACK", b"NAK"):  # some servers begin with data
                parts.setdefault(line[0] if sideband and line else 1, []).append(line[1:] if sideband else line)
        elif sideband:
            if line:
                parts.setdefault(line[0], []).append(line[1:])
        else:
            parts[1].append(line)
    return Fetched(b"".join(parts[1]), *(b"".join(parts[c]).decode("utf-8", "replace") for c in (2, 3)))


def push_request(updates: list[tuple[str, str, str]], pack: bytes, capabilities: Iterable[str] = ("report-status", "delete-refs", "agent=chronolake")) -> bytes:
    """updates: (old sha, new sha, ref); the old one is NULL_SHA for a new ref."""
    if not updates:
        raise FormatError("push: no update")
    out = []
    for i, (old, new, ref) in enumerate(updates):
        if not _is_sha(old) or not _is_sha(new):
            raise FormatError(f"push: not a sha in {old} {new}")
        if not ref.startswith("refs/"):
            raise FormatError(f"push: a ref starts with refs/, not {ref}")
        out.append(pkt_line(f"{old} {new} {ref}" + ("\0" + " ".join(capabilities) if not i else "") + "\n"))
    return b"".join(out) + FLUSH + pack


def parse_push(data: bytes) -> tuple[bool, str | None, list[tuple[str, bool, str | None]]]:
    """(unpacked, error, [(ref, accepted, reason)])."""
    unpacked, error, refs = False, None, []
    for section in pkt_sections(data):
        for line in section:
            text = _text(line)
            text = text[1:] if text and ord(text[0]) <= 3 else text
            word, _, rest = text.partition(" ")
            if word == "unpack":
                unpacked, error = (True, error) if rest == "ok" else (unpacked, rest)
            elif word == "ok":
                refs.append((rest, True, None))
            elif word == "ng":
                ref, space, reason = rest.partition(" ")
                refs.append((ref, False, reason if space else None))
    return unpacked, error, refs


def auth_header(token: str) -> str:
    return "Basic " + base64.b64encode(f"x:{token}".encode()).decode()


# --- commits -------------------------------------------------------------------------------


def encode_commit(tree: str, parents: list[str], author: tuple[str, str, int], message: str, committer: tuple[str, str, int] | None = None, zone: str = "+0000", committer_zone: str | None = None) -> bytes:
    """author, committer: (name, e-mail, seconds)."""
    for sha in (tree, *parents):
        if not _is_sha(sha):
            raise FormatError(f"commit: not a sha: {sha}")
    who = committer or author
    head = [f"tree {tree}", *(f"parent {p}" for p in parents), f"author {author[0]} <{author[1]}> {author[2]} {zone}", f"committer {who[0]} <{who[1]}> {who[2]} {committer_zone or zone}"]
    return ("\n".join(head) + "\n\n" + message).encode()


def commit_tree(body: bytes) -> str:
    found = re.match(rb"tree ([0-9a-f]{40})(?:\n|$)", body)
    if not found:
        raise FormatError("commit: its first line names no tree")
    return found[1].decode()
