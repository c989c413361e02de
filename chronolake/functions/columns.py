"""Column builders: everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "unhex('00')"
SHA1, SHA256 = "^[0-9a-f]{40}$", "^[0-9a-f]{64}$"
BINARY_PREFIX = 8192


def serialized(kind: Column, content: Column) -> Column:
    """Header and body of an object."""
    head = F.concat(kind, F.lit(" "), F.octet_length(content).cast("string"))
    return F.concat(F.encode(head, "UTF-8"), F.expr(NUL), content)


def object_id(kind: str | Column, content: Column) -> Column:
    return F.sha1(serialized(F.lit(kind) if isinstance(kind, str) else kind, content))


def text_of(content: Column) -> Column:
    """UTF-8 with U+FFFD for what is none."""
    return F.make_valid_utf8(content.cast("string"))


def is_binary(content: Column) -> Column:
    """A NUL among the first bytes; each byte counts as a character, so invalid UTF-8 is no hurdle."""
    return F.locate("\0", F.decode(F.substring(content, 1, BINARY_PREFIX), "ISO-8859-1")) > 0


def parse_header(raw: Column) -> Column:
    """Struct (type, size, content) of an object with header; null where it is malformed."""
    head = F.decode(F.substring(raw, 1, 64), "ISO-8859-1")
    nul, space = F.locate("\0", head), F.locate(" ", head)
    size = F.substr(head, space + 1, nul - space - 1)
    ok = (nul > 0) & (space > 0) & (space < nul) & size.rlike("^[0-9]+$")
    return F.when(ok, F.struct(F.substr(head, F.lit(1), space - 1).alias("type"), size.cast("long").alias("size"), F.substr(raw, nul + 1).alias("content")))


def split_lines(text: Column, rule: str) -> Column:
    """Lines by one of three rules. grep: an empty text has one empty line. diff: it has none. blame: an empty last line is dropped too."""
    lines = F.split(text, "\n")
    if rule == "grep":
        return lines
    if rule == "diff":
        return F.when(text == "", F.array().cast("array<string>")).otherwise(lines)
    if rule == "blame":
        return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    raise ValueError(rule)


def _last(lines: Column, pattern: str) -> Column:
    return F.try_element_at(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(-1))


def parse_commit(body: Column) -> Column:
    """Struct of a commit's text; a text without a blank line gives an empty commit, not an error."""
    end = F.locate("\n\n", body)
    head = F.split(F.substr(body, F.lit(1), end - 1), "\n")
    message = F.substr(body, end + 2)
    fields = []
    for who in ("author", "committer"):
        pattern = f"^{who} (.+?) <(.+?)> ([0-9]+)"
        line = F.coalesce(_last(head, pattern), F.lit(""))
        fields += [F.regexp_extract(line, pattern, 1).alias(who), F.regexp_extract(line, pattern, 2).alias(f"{who}_email"), F.coalesce(F.regexp_extract(line, pattern, 3).try_cast("long"), F.lit(0).cast("long")).alias(f"{who}_ts")]
    parents = F.transform(F.filter(head, lambda x: x.startswith("parent ")), lambda x: F.substr(x, F.lit(8)))
    whole = F.struct(F.coalesce(F.substr(_last(head, "^tree "), F.lit(6)), F.lit("")).alias("tree"), parents.alias("parents"), *fields, F.substring_index(message, "\n", 1).alias("summary"), message.alias("message"))
    none = F.struct(F.lit("").alias("tree"), F.array().cast("array<string>").alias("parents"), *(F.lit(0).cast("long").alias(n) if n.endswith("_ts") else F.lit("").alias(n) for n in ("author", "author_email", "author_ts", "committer", "committer_email", "committer_ts")), F.lit("").alias("summary"), F.lit("").alias("message"))
    return F.when(end > 0, whole).otherwise(none)


def encode_commit(tree: Column, parents: Column, name: Column, email: Column, seconds: Column, message: Column, zone: str = "+0000") -> Column:
    who = F.concat(name, F.lit(" <"), email, F.lit("> "), seconds.cast("string"), F.lit(f" {zone}"))
    lines = F.concat(F.array(F.concat(F.lit("tree "), tree)), F.transform(parents, lambda p: F.concat(F.lit("parent "), p)), F.array(F.concat(F.lit("author "), who), F.concat(F.lit("committer "), who)))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), message)


def commit_tree(body: Column) -> Column:
    return F.nullif(F.regexp_extract(body, "^tree ([0-9a-f]{40})(?:\n|$)", 1), F.lit(""))


def is_dir(mode: Column) -> Column:
    return mode.isin("40000", "040000")


def tree_key(mode: Column, name: Column) -> Column:
    """The canonical order of entries: a directory compares as its name and a slash."""
    return F.when(is_dir(mode), F.concat(name, F.lit("/"))).otherwise(name)


def encode_tree(entries: Column) -> Column:
    """Bytes of a tree from an array of (mode, name, sha)."""
    keyed = F.array_sort(F.transform(entries, lambda e: F.struct(tree_key(e["mode"], e["name"]).alias("k"), F.when(is_dir(e["mode"]), F.lit("40000")).otherwise(e["mode"]).alias("mode"), e["name"].alias("name"), e["sha"].alias("sha"))))
    one = lambda e: F.concat(F.hex(F.encode(F.concat(e["mode"], F.lit(" "), e["name"]), "UTF-8")), F.lit("00"), F.upper(e["sha"]))
    return F.unhex(F.array_join(F.transform(keyed, one), ""))


def with_entry(entries: Column, entry: Column) -> Column:
    return F.array_append(without_entry(entries, entry["name"]), entry)


def without_entry(entries: Column, name: Column) -> Column:
    return F.filter(entries, lambda e: e["name"] != name)


def split_path(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def loose_key(repo: Column, sha: Column) -> Column:
    return F.concat_ws("/", repo, F.lit("objects"), F.substring(sha, 1, 2), F.substr(sha, F.lit(3)))


def staged_key(repo: Column, sha: Column) -> Column:
    return F.concat_ws("/", repo, F.lit("loose"), sha)


def worktree_key(repo: Column, branch: Column, path: Column) -> Column:
    return F.concat_ws("/", repo, F.lit("worktrees"), branch, path)


def normalize_repo_url(url: Column) -> Column:
    """One spelling for the addresses of a repository: https, no user, no trailing slash, .git, lower case."""
    u = F.trim(url)
    scp = "^([\\w.-]+)@([\\w.-]+):(.+?)$"
    u = F.when(u.rlike(scp), F.regexp_replace(u, scp, "https://$2/$3")).otherwise(F.regexp_replace(u, "^(ssh|git)://", "https://"))
    u = F.regexp_replace(F.regexp_replace(u, "^(https?://)[^@/]+@", "$1"), "/+$", "")
    u = F.when(F.lower(u).endswith(".git"), u).otherwise(F.concat(u, F.lit(".git")))
    return F.when(F.trim(url) != "", F.lower(u))


def repo_key(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(url), "^https?://", ""), "[^a-z0-9\\-_./]", "-")


def pkt_line(text: Column) -> Column:
    """A framed line; too long a one is an error."""
    n = F.octet_length(text) + 4
    size = F.when(n <= 65520, F.lpad(F.lower(F.hex(n.cast("long"))), 4, "0")).otherwise(F.raise_error(F.lit("line too long")).cast("string"))
    return F.concat(size, text)


def pack_header_length(size: Column) -> Column:
    """Bytes of a pack entry's header."""
    bits = F.when(size < 16, F.lit(0)).otherwise(F.length(F.bin(size)) - 4)
    return (1 + F.ceil(bits / 7)).cast("long")


def basic_auth(token: Column) -> Column:
    return F.concat(F.lit("Basic "), F.base64(F.encode(F.concat(F.lit("x:"), token), "UTF-8")))


def in_scope(key: Column, repo: Column) -> Column:
    return key.isNull() | key.startswith(F.concat(repo, F.lit("/")))


def is_json(text: Column) -> Column:
    """A whole JSON text. The parser ignores what follows a value, so the text also has to fit into an array and an object."""
    array = F.try_parse_json(F.concat(F.lit("["), text, F.lit(",0]")))
    inside = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit(',"b":0}')))
    return F.coalesce((F.try_variant_get(array, "$[1]", "int") == 0) & inside.isNotNull(), F.lit(False))


def metadata_error(repo_id: Column, commit_sha: Column, strings: dict[str, Column], metadata_json: Column) -> Column:
    """The message of the first rule that a metadata row breaks, or null. Limits count characters."""
    out = F.when(repo_id.isNull() | (repo_id == ""), "repo_id must be a non-empty string")
    out = out.when(F.length(repo_id) > 1024, "repo_id too long (max 1024)")
    out = out.when(commit_sha.isNull() | ~commit_sha.rlike(SHA1), "commit_sha must be 40 lowercase hex characters")
    for name, value in strings.items():
        out = out.when(F.length(value) > 512, f"{name} too long (max 512)")
    return out.when(metadata_json.isNotNull() & ~is_json(metadata_json), "metadata_json must be valid JSON when provided as a string")


def prompt_error(prompt_id: Column, text: Column) -> Column:
    """As metadata_error, for prompt texts; their size counts bytes."""
    size = F.octet_length(text)
    out = F.when(prompt_id.isNull(), "prompt_id must be a string").when(~F.length(prompt_id).between(1, 256), "prompt_id length must be 1..256")
    out = out.when(text.isNull(), "text must be a string").when(size == 0, "text must be non-empty")
    return out.when(size > 65536, F.concat(F.lit("text too large ("), size.cast("string"), F.lit(" > 65536 bytes)")))
