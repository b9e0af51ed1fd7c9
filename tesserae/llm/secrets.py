"""Operator 5, secret scans with structural confirmation.

Plain patterns give assignments, access keys and hex strings. Beyond them, strings that may be encoded
keys are decoded, and are reported only if what they hold parses: DER whose nested lengths close and
whose fields are a private key's, key files whose length-prefixed fields fill them, and signed tokens
whose header is JSON that names an algorithm. Keys are read as base64, plain or for URLs, as hex, and as
whole key files that are base64 once more. A bare key's span ends where its own lengths say, whatever words
or digits follow.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import rounds, text_of

#: Fixed order of kinds at one start: the base ones, then those confirmed by structure.
KINDS = ("assign", "access", "hex", "pem", "der", "derhex", "sshkey", "jwt", "pem64")
#: Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Candidates: a DER sequence of two-byte or short length begins with M and A to P in base64, with 30 in hex.
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----((?:(?:\s|\\[nr])*(?:Proc-Type|DEK-Info): ?[A-Za-z0-9,-]+)*)([A-Za-z0-9+/=\s\\]+)-----END \1PRIVATE KEY-----")
#: Headers of an encrypted key file: a cipher and its starting value.
SEALED = re.compile(r"Proc-Type: ?4,ENCRYPTED[\s\S]*DEK-Info: ?[A-Z0-9-]+,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\Z")
#: Bare keys may be wrapped: line breaks, also escaped ones, stand among their characters; where they end their lengths say.
BREAK = r"(?:\s|\\[nr])"
DER64 = re.compile(r"(?<![A-Za-z0-9+/])M[A-P]")
DERHEX = re.compile(r"(?<![0-9a-fA-F])30:?(?:[0-7][0-9a-fA-F]|8[1-4])")
SSH64 = re.compile(r"(?<![A-Za-z0-9+/])b3BlbnNzaC1rZXktdjE")
#: A whole key file in base64 begins with that of five dashes and BEGIN.
PEM64 = re.compile(r"(?<![A-Za-z0-9+/])LS0tLS1CRUdJTi")
RUN = re.compile(rf"{BREAK}*([A-Za-z0-9+/]+)")
RUN_URL = re.compile(rf"{BREAK}*([A-Za-z0-9_-]+)")
RUN_HEX = re.compile(rf"(?:{BREAK}|:)*([0-9a-fA-F]+)")
PAD = re.compile(rf"{BREAK}*=")
BROKEN = re.compile(BREAK)
#: Bytes of the shortest bare key.
LEAST = 30
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER value at a place, if its length is canonical and stays within end."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n = int.from_bytes(data[at : at + k], "big")
        if n < 0x80 or n >> (8 * (k - 1)) == 0:
            return None
        at += k
    return (tag, at, at + n) if at + n <= end else None


def fields(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill a range exactly, or None."""
    out = []
    while at < end:
        if (v := tlv(data, at, end)) is None:
            return None
        out.append(v)
        at = v[2]
    return out


# DER of the arcs that schemes of password-encrypted keys are under (PKCS#5, PKCS#12).
SEALING = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
# Tags of what may follow the key in PKCS#8 (attributes, public key) and in SEC1 (curve, public key).
AFTER_KEY, AFTER_SCALAR = {0xA0, 0xA1, 0x81}, {0xA0, 0xA1}


def inner_key(data: bytes) -> bool:
    """What the octets of PKCS#8 hold: one value that fills them, a sequence of parsed fields from an integer on, the octets of a curve key, or an integer."""
    top = tlv(data, 0, len(data))
    if not top or top[2] != len(data):
        return False
    size = top[2] - top[1]
    if top[0] == 0x30:
        parts = fields(data, *top[1:])
        return bool(parts) and len(parts) > 1 and parts[0][0] == 0x02 and all(t == 0x02 for t, _, _ in parts[:9] if len(parts) >= 9) and size >= 16
    return top[0] == 0x04 and size in (32, 56, 57) or top[0] == 0x02 and size >= 16


def private_der(data: bytes) -> bool:
    """A DER private key: PKCS#1 (nine integers), PKCS#8 (version, algorithm, a key that parses), its encrypted form, or SEC1."""
    top = tlv(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data) or not (parts := fields(data, *top[1:])):
        return False
    tags, values = [t for t, _, _ in parts], [data[a:b] for _, a, b in parts]
    if tags == [0x30, 0x04]:
        scheme = fields(values[0], 0, len(values[0]))
        if not scheme or [t for t, _, _ in scheme] != [0x06, 0x30]:
            return False
        return values[0][scheme[0][1] : scheme[0][2]].startswith(SEALING) and bool(fields(values[0], *scheme[1][1:])) and len(values[1]) >= 16
    if tags[0] != 0x02 or values[0] not in (b"\0", b"\x01"):
        return False
    if len(tags) >= 9 and all(t == 0x02 for t in tags[:9]):
        return len(values[1]) >= 32
    if tags[1:3] == [0x30, 0x04]:
        algorithm = fields(values[1], 0, len(values[1]))
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(algorithm) <= 2 and set(tags[3:]) <= AFTER_KEY and inner_key(values[2])
    return tags[1:2] == [0x04] and values[0] == b"\x01" and 16 <= len(values[1]) <= 66 and set(tags[2:]) <= AFTER_SCALAR


def key_file(headers: str, body: bytes) -> bool:
    """The body of a key file: a private key, or under headers of encryption whole cipher blocks."""
    if SEALED.search(re.sub(r"\\[nr]", "\n", headers)):
        return len(body) >= 16 and len(body) % 8 == 0
    return private_der(body) or private_ssh(body)


def der_size(data: bytes) -> int:
    """The bytes of a DER sequence that begins with an integer or a sequence, as its own length states; 0 if data begins with none."""
    top = tlv(data, 0, 1 << 40)
    return top[2] if top and top[0] == 0x30 and data[top[1] : top[1] + 1] in (b"\x02", b"\x30") else 0


def ssh_size(data: bytes) -> int:
    """The bytes of an OpenSSH private key: its magic, then cipher, kdf, options, a count of keys, and that many keys and their secrets.

    0 if data begins with none; if data is too short, the bytes that are needed to read on.
    """
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return 0
    at, left, counted = len(magic), 3, False
    while left:
        if at + 4 > len(data):
            return at + 4
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return at
        left -= 1
        if not left and not counted:
            if at + 4 > len(data):
                return at + 4
            n = int.from_bytes(data[at : at + 4], "big")
            if not 1 <= n <= 64:
                return 0
            at, left, counted = at + 4, n + 1, True
    return at


def private_ssh(data: bytes) -> bool:
    """An OpenSSH private key that fills data."""
    return ssh_size(data) == len(data) > 0


def unbase64(text: str, url: bool = False) -> bytes:
    """The bytes of base64 text, white space and padding aside; none if it is not base64."""
    body = re.sub(r"\s|\\n|\\r", "", text).rstrip("=")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return b""


def unhex(text: str) -> bytes:
    return bytes.fromhex(text[: len(text) & ~1])


#: How bytes are written: what a run of characters is, bytes and characters that go together, and how they are read.
BASE64, BASE64_URL, HEXED = (RUN, 3, 4, unbase64), (RUN_URL, 3, 4, lambda x: unbase64(x, True)), (RUN_HEX, 1, 2, unhex)


def taken(text: str, at: int, n: int, run: re.Pattern = RUN) -> tuple[str, int] | None:
    """The n characters of an encoding from a place on, breaks aside, and the end of the last; None if there are fewer."""
    out: list[str] = []
    while n and len(text) - at >= n and (m := run.match(text, at)):
        out.append(m[1][:n])
        n -= len(out[-1])
        at = m.start(1) + len(out[-1])
    return None if n else ("".join(out), at)


def bare_end(text: str, at: int, size_of: Callable[[bytes], int], private: Callable[[bytes], bool], form: tuple = BASE64) -> int | None:
    """Where the bare encoded key at a place ends, by the size that its own fields state, padding included; None if there is none."""
    run, n_bytes, n_chars, read = form
    size, need = LEAST, 0
    while size > need:
        need = size
        if (found := taken(text, at, -(-n_chars * need // n_bytes), run)) is None:
            return None
        data = read(found[0])[:need]
        size = size_of(data)
    if size < LEAST or not private(data[:size]):
        return None
    chars, end = found
    for _ in range(-len(chars) % 4 if form is not HEXED else 0):
        if m := PAD.match(text, end):
            end = m.end()
    return end


def key_file_end(text: str, at: int) -> int | None:
    """Where the base64 of a whole key file at a place ends, padding included; None if what it decodes to is none.

    The base64 may be wrapped, and words may follow it: what counts are the characters that the file's last line needs.
    """
    chars, end = [], at
    while m := RUN.match(text, end):
        chars.append(m[1])
        end = m.end()
    body = "".join(chars)
    data = base64.b64decode(body[: len(body) & ~3]) + unbase64(body[len(body) & ~3 :])
    m = PEM.match(data.decode("latin-1"))
    if not m or not key_file(m[2], unbase64(m[3])):
        return None
    # a line break that closes the file is its own
    size = m.end() + (data[m.end() : m.end() + 1] == b"\n") + (data[m.end() : m.end() + 2] == b"\r\n") * 2
    chars, end = taken(text, at, -(-4 * size // 3))
    for _ in range(-len(chars) % 4):
        if p := PAD.match(text, end):
            end = p.end()
    return end


def signed_token(token: str) -> bool:
    """A JSON web token: header and payload are JSON objects, the header names an algorithm, the signature decodes."""
    header, payload, signature = token.split(".")
    try:
        h, p = json.loads(unbase64(header, True)), json.loads(unbase64(payload, True))
    except ValueError:
        return False
    if not isinstance(h, dict) or not isinstance(p, dict) or not isinstance(h.get("alg"), str):
        return False
    return h["alg"].lower() == "none" or len(unbase64(signature, True)) >= 16


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """Start, kind's place in KINDS and end of every secret in a text, in that order, as (start, order, end)."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [(m.start(), 3, m.end()) for m in PEM.finditer(text) if key_file(m[2], unbase64(m[3]))]
    if "M" in text:
        files, after = [(a, b) for a, k, b in out if k == 3], 0
        for m in DER64.finditer(text):
            if m.start() < after:
                continue
            if not (after_it := bare_end(text, m.start(), der_size, private_der)) and text[m.start() - 1 : m.start()] not in ("-", "_"):
                after_it = bare_end(text, m.start(), der_size, private_der, BASE64_URL)
            if after_it:
                after = after_it
                # the body of a key file in lines is that file's
                if not (BROKEN.search(text, m.start(), after) and any(a <= m.start() < b for a, b in files)):
                    out.append((m.start(), 4, after))
    if "30" in text:
        after = 0
        for m in DERHEX.finditer(text):
            if m.start() >= after and (after_it := bare_end(text, m.start(), der_size, private_der, HEXED)):
                out.append((m.start(), 5, after := after_it))
    if "b3BlbnNzaC1rZXktdjE" in text:
        out += [(m.start(), 6, z) for m in SSH64.finditer(text) if (z := bare_end(text, m.start(), ssh_size, private_ssh))]
    if "eyJ" in text:
        out += [(m.start(), 7, m.end()) for m in JWT.finditer(text) if signed_token(m[0])]
    if "LS0tLS1CRUdJTi" in text:
        out += [(m.start(), 8, z) for m in PEM64.finditer(text) if (z := key_file_end(text, m.start()))]
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of each whole text: (id, n_assign, n_access, n_hex, base_sha256, spans).

    Spans are in code points, end exclusive, by start, then by the order of KINDS. A null or empty
    text has none. One row for each row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in (part for whole in batches for part in rounds(whole)):
            rows = []
            for text in texts:
                spans = spans_of(text)
                base = [s for s in spans if s[1] < 3]
                rows.append((*(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """docs with every secret in the text replaced by the mark; a null text stays null, other columns as they were."""
    @F.arrow_udf("string")
    def clean(text: pa.Array) -> pa.Array:
        # scalars become Python strings one at a time
        return pa.array((t if (t := x.as_py()) is None else redacted(t, spans_of(t), mark) for x in text), pa.string())

    return docs.withColumn(text_col, clean(F.col(text_col)))


def op5(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return scan(docs).withColumnRenamed("id", "doc_id")
