"""Secret scan: pattern candidates plus structural confirmation.

Three base patterns report spans as they stand.  Further candidates (PEM
blocks, signed tokens, long base64 or hex runs) are reported only when they
decode to a known structure: DER key encodings whose nested lengths add up,
length-prefixed key blobs, or a signed-token header naming its algorithm.  A
candidate may be wrapped over lines, its line ends may be escaped, a path may
stand before it, and it may be encoded any number of times."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORD = re.compile(r"(?:passw(?:or)?d|secret|token|api_?key)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)(PRIVATE KEY|PUBLIC KEY|CERTIFICATE)-----((?:(?!-----).)*)-----END \1\2-----", re.S)
#: Header lines of a PEM body, and the two that say how it is encrypted.
_HEADER = re.compile(r"[A-Za-z0-9-]+:")
_ENCRYPTED = re.compile(r"Proc-Type:\s*4\s*,\s*ENCRYPTED\s.*?DEK-Info:\s*[A-Z0-9-]+\s*,\s*[0-9A-Fa-f]{16,}\s", re.S)
_SIGNED = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
# the shortest key encoding that is_der_key accepts has 24 bytes
_B64 = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
_HEX_ANY = re.compile(r"[0-9a-fA-F]{48,}")
#: Two or more lines of base64, their ends as they are or escaped.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:(?:\\r)?\\n|\r?\n)(?:[A-Za-z0-9+/_-]{16,}+(?:(?:\\r)?\\n|\r?\n))*+[A-Za-z0-9+/_-]++={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: How a key encoding begins in base64 (a SEQUENCE, the private container, a
#: public blob) where a path or another run stands before it.
_BEGINS = re.compile(r"(?<=[/+_-])(?=M[A-P]|b3Blbn|AAAA)")

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "pem", "signed", "der", "blob")


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER element at ``at``; None if its length is
    malformed or runs past ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at:at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= end else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while start < end:
        el = _tlv(data, start, end)
        if el is None:
            return None
        out.append(el)
        start = el[2]
    return out


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that fills ``data`` exactly, with the children of a private
    key (version, then eight integers or more, the five of a DSA key, an
    algorithm or an octet string), an encrypted one (algorithm, octet string),
    a public key (algorithm, bit string) or a certificate (body, algorithm,
    bit string)."""
    top = _tlv(data, 0, len(data)) if data[:1] == b"\x30" else None
    if top is None or top[2] != len(data) or len(data) < 24:
        return False
    kids = _children(data, top[1], top[2])
    if not kids:
        return False
    tags = [t for t, _, _ in kids]
    for t, s, e in kids:
        if t in (0x30, 0x31, 0xA0, 0xA1) and _children(data, s, e) is None:
            return False
    names_algorithm = lambda el: data[el[1]:el[1] + 1] == b"\x06"
    if tags[0] == 0x02 and kids[0][2] - kids[0][1] == 1:
        if set(tags[:9]) == {0x02} and len(tags) >= 9 or tags == [0x02] * 6:
            return True
        if tags[1:3] == [0x30, 0x04] and names_algorithm(kids[1]):
            return True
        return len(tags) >= 2 and tags[1] == 0x04 and set(tags[2:]) <= {0xA0, 0xA1} and len(tags) > 2
    if tags in ([0x30, 0x03], [0x30, 0x04]):
        return names_algorithm(kids[0])
    return tags == [0x30, 0x30, 0x03] and names_algorithm(kids[1])


def is_key_blob(data: bytes) -> bool:
    """Length-prefixed key formats: the private container, or a public blob
    whose fields consume all bytes."""
    if data.startswith(b"openssh-key-v1\0"):
        at, need = 15, 3
    else:
        at, need = 0, 2
    fields = 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at:at + 4], "big")
        if n > len(data) - at - 4:
            return False
        part, at = data[at + 4:at + 4 + n], at + 4 + n
        if need == 2 and fields == 0 and not re.fullmatch(rb"(?:ssh-|ecdsa-sha2-|sk-ssh-)[a-z0-9@.-]+", part):
            return False
        fields += 1
        if need == 3 and fields == need:
            return True
    return need == 2 and fields >= 2 and at == len(data)


def _unb64(s: str) -> bytes | None:
    s = "".join(s.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_header(part: str) -> bool:
    raw = _unb64(part)
    try:
        head = json.loads(raw) if raw and raw[:1] == b"{" else None
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def is_pem_key(body: str) -> bool:
    """A PEM body (line ends may be escaped) whose data is a key encoding, or
    whose headers name its encryption and whose data is whole cipher blocks."""
    lines = [x.strip() for x in body.replace("\\r", "").replace("\\n", "\n").split("\n")]
    data = _unb64("".join(x for x in lines if not _HEADER.match(x)))
    if not data:
        return False
    if _ENCRYPTED.search("\n".join(lines)):
        return len(data) % 8 == 0
    return _structure(data) is not None


def _structure(data: bytes | None) -> str | None:
    """What ``data`` is, decoded as long as it is an encoding (which gets
    shorter each time)."""
    while data:
        if is_der_key(data):
            return "der"
        if is_key_blob(data):
            return "blob"
        if len(data) < 32 or not data.isascii():
            return None
        text = data.decode("ascii").strip()
        if m := _PEM.search(text):
            return "der" if is_pem_key(m[3]) else None
        if _HEX_ANY.fullmatch(text) and len(text) % 2 == 0:
            data = bytes.fromhex(text)
        elif re.fullmatch(r"[A-Za-z0-9+/_\s-]+={0,2}", text):
            data = _unb64(text)
        else:
            return None
    return None


def _decoded(run: str) -> bytes | None:
    """Bytes of a hex or base64 run."""
    if _HEX_ANY.fullmatch(run):
        return bytes.fromhex(run) if len(run) % 2 == 0 else None
    return _unb64(run)


def _in_run(run: str) -> tuple[int, str] | None:
    """(offset, kind) of the structure that ends a run, at its start or after
    a separator behind which a key encoding may begin."""
    if kind := _structure(_decoded(run)):
        return 0, kind
    for m in _BEGINS.finditer(run):
        if len(run) - m.start() >= 32 and (kind := _structure(_unb64(run[m.start():]))):
            return m.start(), kind
    return None


def _may_fill(first: str, chars: int) -> bool:
    """Whether a base64 text of ``chars`` characters that begins with ``first``
    can be what its DER header says, if it has one."""
    head = _unb64(first[:8]) or b""
    if head[:1] != b"\x30":
        return True
    n, k = head[1], head[1] & 0x7F
    size = n + 2 if n < 0x80 else int.from_bytes(head[2:2 + k], "big") + 2 + k if 1 <= k <= 4 else -1
    return abs(chars * 3 / 4 - size) <= 4


def _wrapped_blocks(text: str):
    """(start, end, joined) of runs of lines that one encoder may have
    wrapped: lines of one length, and a last one that is no longer.  A block
    starts where the length changes, or at a line that begins a key encoding."""
    for m in _WRAPPED.finditer(text):
        lines = [(x.start() + m.start(), x.end() + m.start()) for x in _LINE.finditer(re.sub(r"\\[rn]", "  ", m[0]))]
        size = [e - s for s, e in lines]
        done = -1
        for i in range(len(lines) - 1):
            starts_key = _BEGINS.match("/" + text[lines[i][0]:lines[i][0] + 6], 1) is not None
            if i <= done or not (i == 0 or size[i - 1] != size[i] or starts_key):
                continue
            j = i
            while j + 1 < len(lines) and size[j] == size[i] and size[j + 1] <= size[i]:
                j += 1
            if j > i and (i == 0 or size[i - 1] != size[i] or _may_fill(text[lines[i][0]:lines[i][1]], lines[j][1] - lines[j][0] + sum(size[i:j]))):
                got = yield lines[i][0], lines[j][1], "".join(text[s:e] for s, e in lines[i:j + 1])
                done = j if got else done


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if _ASSIGN_WORD.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "-----BEGIN " in text:
        out += [(m.start(), m.end(), "pem") for m in _PEM.finditer(text) if is_pem_key(m[3])]
    if "ey" in text:  # base64 of '{"' and of '{ ' begins so
        out += [(m.start(), m.end(), "signed") for m in _SIGNED.finditer(text) if is_signed_header(m[1])]
    whole = []
    blocks, got = _wrapped_blocks(text), None
    while True:
        try:
            start, end, run = blocks.send(got)
        except StopIteration:
            break
        got = _structure(_decoded(run))
        if got:
            whole.append((start, end, got))
    out += whole
    at = 0
    for m in _B64.finditer(text):
        while at < len(whole) and whole[at][1] <= m.start():
            at += 1
        if at < len(whole) and whole[at][0] <= m.start():
            continue  # a line of a wrapped key
        if found := _in_run(m[0]):
            out.append((m.start() + found[0], m.end(), found[1]))
    return out


def spans(text: str | None) -> tuple[list, list]:
    """(base, all) spans (start, end, kind) in code points, by start, then
    kind as listed in ``KINDS``."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = base_spans(text) if text else []
    return sorted(base, key=order), sorted(base + (confirmed_spans(text) if text else []), key=order)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, found) for every row: arrays of (kind, start, end).
    Row-local, no shuffle.  Null texts count as empty; texts of any length are
    scanned whole; repeated rows and rows with a null id each return a row;
    other columns are not read; an empty table gives an empty one."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        as_rows = lambda found: [{"kind": k, "start": s, "end": e} for s, e, k in found]
        for b in batches:
            both = [spans(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([as_rows(x[i]) for x in both], span) for i in (0, 1))], names=["doc_id", "base", "found"])

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    of = "array<struct<kind:string,start:long,end:long>>"
    return ids.mapInArrow(run, f"doc_id long, base {of}, found {of}")


def joined(spans_col: str) -> "F.Column":
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(text: str | None) -> str:
    """The digest of a text's base spans, as the query returns it."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans(text)[0]).encode()).hexdigest()
