"""Operator 13: secret scans with structural confirmation.

Patterns find assignments, access keys and long hexadecimal runs; they are reported as they match. Key material is reported
only when its structure holds: a candidate in base64 (one run, or lines of a wrapped block) or hexadecimal is decoded, and
its bytes must be a private key whose nested lengths all come out even: DER of PKCS#1, PKCS#8 (plain or encrypted), SEC 1
or DSA, where each length lies inside its parent's and the parts fill it, or the OpenSSH container with its counted strings
and check numbers. A signed token must have a header that decodes to a JSON object with a known algorithm, a payload that
decodes to one, and a signature of that algorithm's length. Public keys, certificates, digests and random runs decode but
fail, and are not reported.

A candidate is looked at once: the outer length, two bytes at most, says how much is decoded (an encoding of more than 64
KB is no key of these formats), so a text of any length is scanned in time proportional to it. Places are code points, the
end exclusive. Each text is scanned whole, in one pass; nothing is shuffled.

Defined cases: a null text is an empty one and has no spans; rows that repeat an identifier, or have none, are documents of
their own; spans may overlap, base ones and confirmed ones alike, and are ordered by start, then by kind as listed, then by
end; an empty table gives an empty result; extra columns take no part.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteql.llm.common import ship

BASE = ("assign", "access", "hex")
CONFIRMED = ("token", "rsa", "pkcs8", "pkcs8_encrypted", "ec", "dsa", "openssh")
KINDS = {kind: i for i, kind in enumerate(BASE + CONFIRMED)}

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # of maximal runs, those of 32 characters or more
LEAST = {"assign": 8, "access": 16}

#: Where an encoding can begin: not inside a run, but after an escaped line end or the dashes of a heading.
_BEGIN = r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n)|(?<=-----))"
MAGIC = b"openssh-key-v1\0"
#: A run that begins like a DER sequence (30, in base64 M and A to P) or the OpenSSH container.
IN_BASE64 = re.compile(_BEGIN + r"(?:M[A-P]|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9+/_-]{18,}")
IN_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]763100)[0-9A-Fa-f]{38,}(?![0-9A-Fa-f])")
LINE = re.compile(r"(?:\r?\n|\\r\\n|\\n)([A-Za-z0-9+/_-]+)")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])e[wy][A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*(?![A-Za-z0-9_-]|\.[A-Za-z0-9_-])")

#: Bytes of a signature by its algorithm; RSA's are as long as the key.
SIGNATURE = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114), "none": (0,)}
SIGNATURE |= dict.fromkeys(("RS256", "RS384", "RS512", "PS256", "PS384", "PS512"), (128, 192, 256, 384, 512, 1024))

INTEGER, OCTETS, OBJECT, SEQUENCE, PARAMETERS, PUBLIC = 0x02, 0x04, 0x06, 0x30, 0xA0, 0xA1
#: Object identifiers, encoded: RSA, EC, and the password-based schemes' common beginning.
RSA_ID, EC_ID, PASSWORD_ID = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2a864886f70d0105")
#: X25519, X448, Ed25519, Ed448 with their key lengths.
CURVES = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}


# -- structures ----------------------------------------------------------------------------------------------------


def outer(data: bytes) -> int | None:
    """How many bytes a sequence takes by its first four, or None."""
    if len(data) < 4 or data[0] != SEQUENCE:
        return None
    if data[1] < 0x80:
        return 2 + data[1]
    if data[1] == 0x81:
        return 3 + data[2] if data[2] >= 0x80 else None
    if data[1] == 0x82:
        n = int.from_bytes(data[2:4], "big")
        return 4 + n if n > 0xFF else None
    return None


def parts(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents that fill data exactly, with lengths in their shortest form; else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or data[at] & 0x1F == 0x1F:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n >= 0x80:
            k = n & 0x7F
            if not 1 <= k <= 2 or at + k > len(data):
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
            if n < 0x80 or k == 2 and n <= 0xFF:
                return None
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def _number(part: tuple[int, bytes]) -> int | None:
    tag, data = part
    return int.from_bytes(data, "big", signed=True) if tag == INTEGER and data else None


def _rsa(p: list[tuple[int, bytes]]) -> bool:
    """Version, modulus, exponents, primes, and what follows from them: nine numbers, ten parts with further primes."""
    n = [_number(x) for x in p[:9]]
    if len(p) not in (9, 10) or None in n or n[0] != len(p) - 9 or len(p) == 10 and p[9][0] != SEQUENCE:
        return False
    return min(n[1:]) > 0 and n[1].bit_length() >= 256 and n[2] % 2 == 1 and max(n[2:]) < n[1] and (len(p) == 10 or n[4] * n[5] == n[1])


def _dsa(p: list[tuple[int, bytes]]) -> bool:
    """Version 0, p, q, g, public and private number."""
    n = [_number(x) for x in p]
    return len(p) == 6 and None not in n and n[0] == 0 and n[1].bit_length() >= 512 and 0 < n[5] < n[2] < n[1] and 0 < n[3] < n[1] and 0 < n[4] < n[1]


def _ec(p: list[tuple[int, bytes]], named: bool = True) -> bool:
    """Version 1, the private number, then the curve and the public point, each optional; alone, a key names its curve."""
    if not 2 <= len(p) <= 4 or _number(p[0]) != 1 or p[1][0] != OCTETS or not 16 <= len(p[1][1]) <= 66:
        return False
    tags = [t for t, _ in p[2:]]
    return tags in ([PARAMETERS], [PARAMETERS, PUBLIC], *([] if named else [[], [PUBLIC]])) and all(len(parts(d) or ()) == 1 for _, d in p[2:])


def _pkcs8(p: list[tuple[int, bytes]]) -> bool:
    """Version, algorithm, and the key in that algorithm's own encoding; attributes may follow."""
    if len(p) < 3 or _number(p[0]) not in (0, 1) or p[1][0] != SEQUENCE or p[2][0] != OCTETS or any(t & 0xC0 != 0x80 for t, _ in p[3:]):
        return False
    algorithm, inner = parts(p[1][1]), parts(p[2][1])
    if not algorithm or algorithm[0][0] != OBJECT or not inner or len(inner) != 1:
        return False
    name, (tag, data) = algorithm[0][1], inner[0]
    if name in CURVES:
        return tag == OCTETS and len(data) == CURVES[name]
    if name == RSA_ID or name == EC_ID:
        found = parts(data) if tag == SEQUENCE else None
        return bool(found) and (_rsa(found) if name == RSA_ID else _ec(found, named=False))
    return tag == INTEGER and len(data) >= 16 or tag == SEQUENCE and bool(parts(data))


def _encrypted(p: list[tuple[int, bytes]]) -> bool:
    """A password-based scheme with its parameters, and what it encrypted."""
    if len(p) != 2 or p[0][0] != SEQUENCE or p[1][0] != OCTETS or len(p[1][1]) < 32:
        return False
    scheme = parts(p[0][1])
    return bool(scheme) and len(scheme) == 2 and scheme[0][0] == OBJECT and scheme[0][1].startswith(PASSWORD_ID) and scheme[1][0] == SEQUENCE and bool(parts(scheme[1][1]))


def der_kind(data: bytes) -> str | None:
    """Which private key a sequence is, all of data being it."""
    whole = parts(data)
    inside = parts(whole[0][1]) if whole and len(whole) == 1 and whole[0][0] == SEQUENCE else None
    if not inside:
        return None
    for kind, holds in (("rsa", _rsa), ("pkcs8", _pkcs8), ("pkcs8_encrypted", _encrypted), ("ec", _ec), ("dsa", _dsa)):
        if holds(inside):
            return kind
    return None


def _strings(data: bytes, at: int, n: int) -> tuple[list[bytes], int] | None:
    """n counted strings from a place on, and where they end."""
    out = []
    for _ in range(n):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def openssh_size(data: bytes) -> int | None:
    """How many bytes the OpenSSH container takes that data begins with, or None: cipher, key derivation and its options,
    the public keys, and the private part, whose two check numbers agree unless it is encrypted."""
    if not data.startswith(MAGIC) or not (found := _strings(data, len(MAGIC), 3)):
        return None
    (cipher, kdf, options), at = found
    n = int.from_bytes(data[at : at + 4], "big")
    if not 1 <= n <= 16 or not (found := _strings(data, at + 4, n + 1)):
        return None
    strings, end = found
    secret = strings[-1]
    if len(secret) < 16 or len(secret) % 8 or not all(k[4 : 4 + int.from_bytes(k[:4], "big")].isascii() and len(k) > 8 for k in strings[:-1]):
        return None
    if cipher == b"none":
        return end if kdf == b"none" and not options and secret[:4] == secret[4:8] else None
    return end if kdf == b"bcrypt" and options else None


# -- candidates ----------------------------------------------------------------------------------------------------

_STANDARD = str.maketrans("-_", "+/")


def _decoded(run: str) -> bytes:
    """The whole bytes of a run of base64."""
    run = run[: len(run) - (len(run) % 4 == 1)].translate(_STANDARD)
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _base64_key(text: str, start: int, end: int) -> tuple[str, int] | None:
    """The key in base64 that begins with the run from start to end, and where it ends."""
    head = _decoded(text[start : min(end, start + 24)])
    openssh = head.startswith(MAGIC)
    need = 1 << 16 if openssh else outer(head)
    if not need:
        return None
    chars, places, have = -(-need * 4 // 3), [(start, end)], end - start
    while have < chars and (line := LINE.match(text, places[-1][1])):
        places.append(line.span(1))
        have += line.end(1) - line.start(1)
    if have < chars and not openssh:
        return None
    data = _decoded("".join(text[a:b] for a, b in places))
    if openssh:
        need = openssh_size(data)
        if not need:
            return None
        kind, chars = "openssh", -(-need * 4 // 3)
    else:
        kind = der_kind(data[:need])
        if not kind:
            return None
    for a, b in places:
        if chars <= b - a:
            # the encoding ends with its run, padding aside
            return (kind, _padded(text, b, -need % 3)) if chars == b - a else None
        chars -= b - a
    return None


def _padded(text: str, at: int, n: int) -> int:
    return at + n if n and text.startswith("=" * n, at) else at


def _hex_key(run: str) -> str | None:
    try:
        data = binascii.unhexlify(run)
    except binascii.Error:  # an odd number of digits
        return None
    if data.startswith(MAGIC):
        return "openssh" if openssh_size(data) == len(data) else None
    return der_kind(data) if outer(data[:4]) == len(data) else None


def _object(run: str) -> dict | None:
    try:
        found = json.loads(_decoded(run))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed(token: str) -> bool:
    """Whether header, payload and signature of a token hold together."""
    head, payload, signature = token.split(".")
    header = _object(head)
    sizes = SIGNATURE.get(header["alg"]) if header and isinstance(header.get("alg"), str) else None
    return sizes is not None and len(signature) % 4 != 1 and len(signature) * 3 // 4 in sizes and _object(payload) is not None


def spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of all secrets of a text, in order."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "ey" in text or "ew" in text:
        out += [("token", m.start(), m.end()) for m in TOKEN.finditer(text) if signed(m[0])]
    for m in IN_BASE64.finditer(text):
        if found := _base64_key(text, m.start(), m.end()):
            out.append((found[0], m.start(), found[1]))
    for m in IN_HEX.finditer(text):
        if kind := _hex_key(m[0]):
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS[s[0]], s[2]))


# -- tables --------------------------------------------------------------------------------------------------------


def found(docs: DataFrame) -> DataFrame:
    """doc_id, spans: an array of kind, start, end for each document."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            at, kinds, starts, ends = [0], [], [], []
            for x in batch.column(1):
                for kind, start, end in spans(x.as_py() or ""):
                    kinds.append(kind)
                    starts.append(start)
                    ends.append(end)
                at.append(len(kinds))
            inner = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), inner)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,`end`:long>>")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: what a document has, as counts, a digest and a list."""
    rows, all_ = found(docs), F.col("spans")
    count = lambda kind: F.size(F.filter(all_, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _listed(F.filter(all_, lambda s: s["kind"].isin(*BASE)))
    return rows.select("doc_id", *map(count, BASE), F.sha2(base, 256).alias("base_sha256"), _listed(all_).alias("spans"))
