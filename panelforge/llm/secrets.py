"""Secret scans with structural confirmation.

Three base patterns are reported wherever they match. Beyond them, base64 and hex candidates are decoded
and reported only if what they hold is built like a key: DER with lengths that nest exactly (PKCS#1,
PKCS#8 plain or encrypted, SEC 1), an OpenSSH private key with its length-prefixed fields, or a signed
token whose header decodes to JSON that names an algorithm. PEM armour is confirmed by its body, an
encrypted body by its cipher headers. Keys are looked for at every place of a run of base64 or hex
digits, also of one that is wrapped over lines: the first bytes must state a length and a version, and
exactly that length is decoded, so that the work stays linear in the text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelforge.llm.common import documents, map_arrow

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
DEK = re.compile(r"DEK-Info: *([A-Za-z0-9-]+),([0-9A-Fa-f]+)")
#: Three dotted runs, looked at from each run's start; the header's JSON begins with "eyJ" and takes HEADER letters at most.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{11,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*))")
HEADER = 4096
#: A run of base64 letters, also one wrapped over lines. Its first line has 40 letters at least.
RUN = re.compile(r"[A-Za-z0-9+/]{40,}(?:\r?\n[A-Za-z0-9+/]{1,}(?![^\r\n=]))*={0,2}")
HEX_RUN = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
#: Where a key may begin in a run. DER starts with a SEQUENCE (0x30), whose first base64 letter is M;
#: the letters or digits after it state its length in one byte, or in one to three more.
START64 = re.compile(r"M(?=[A-Z][A-Za-z0-9+/])|b3BlbnNzaC1rZXktdjE")
START16 = re.compile(r"30(?=[0-8][0-9a-f])|" + b"openssh-key-v1".hex())
#: No private key is longer than this.
MOST = 1 << 16
MAGIC = b"openssh-key-v1\0"
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "token")
ORDER = {k: i for i, k in enumerate(KINDS)}


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, body) of the DER items that fill ``data`` exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n >= 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def is_der_key(data: bytes) -> bool:
    """A private key: SEQUENCE of version 0 or 1 and, exactly nested, numbers, a key string or an algorithm with one."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    items = der_items(top[0][1])
    if not items or len(items) < 2 or items[0][0] != 0x02 or items[0][1] not in (b"\0", b"\1"):
        return False
    tags = [t for t, _ in items]
    if len(items) >= 6 and all(t == 0x02 for t in tags):  # PKCS#1 or DSA
        return True
    if tags[:2] == [0x02, 0x04] and len(items[1][1]) >= 16:  # SEC 1
        return True
    if tags[:3] == [0x02, 0x30, 0x04]:  # PKCS#8
        algorithm = der_items(items[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def is_sealed_key(data: bytes) -> bool:
    """An encrypted PKCS#8 key: an algorithm that begins with its name, then the ciphertext."""
    top = der_items(data)
    items = der_items(top[0][1]) if top and len(top) == 1 and top[0][0] == 0x30 else None
    if not items or [t for t, _ in items] != [0x30, 0x04] or len(items[1][1]) < 16:
        return False
    algorithm = der_items(items[0][1])
    return bool(algorithm) and algorithm[0][0] == 0x06 and len(algorithm[0][1]) >= 3


def openssh_size(data: bytes) -> int:
    """Bytes of the OpenSSH private key that ``data`` begins with: the magic word, cipher, kdf, options (length-prefixed), a count, and that many keys; 0 for none."""
    if not data.startswith(MAGIC):
        return 0
    at, fields = len(MAGIC), []
    for _ in range(3):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return 0
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 16 or not fields[0]:
        return 0
    for _ in range(count + 1):
        n = int.from_bytes(data[at : at + 4], "big")
        if not n or at + 4 + n > len(data):
            return 0
        at += 4 + n
    return at


def der_size(head: bytes) -> int:
    """Bytes of the DER key that begins with ``head`` (16 bytes or all): a SEQUENCE with a version or another SEQUENCE first; 0 if it can be none."""
    if len(head) < 4 or head[0] != 0x30:
        return 0
    n, at = head[1], 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 3 or len(head) < at + k + 3:
            return 0
        n, at = int.from_bytes(head[at : at + k], "big"), at + k
    if not (head[at : at + 3] in (b"\2\1\0", b"\2\1\1") or head[at] == 0x30):
        return 0
    return at + n if 16 <= n <= MOST else 0


def decoded(text: str) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def structure(data: bytes | None) -> str | None:
    """The kind of key that ``data`` holds as a whole."""
    if not data:
        return None
    return "der" if is_der_key(data) or is_sealed_key(data) else "openssh" if openssh_size(data) else None


def keys_in(run: str, start: re.Pattern, letters: int, size: int, decode) -> list[tuple[int, int, str]]:
    """(from, to, kind) of the keys in a run. ``letters`` of the run stand for ``size`` bytes."""
    found, at = [], 0
    while m := start.search(run, at):
        a, at = m.start(), m.start() + 1
        if run[a] == "b" or m[0].startswith("6f"):
            head = decode(run[a : a + 24 * letters // size]) or b""
            named = head.startswith(MAGIC) and 1 <= int.from_bytes(head[15:19], "big") <= 64  # the cipher's name follows
            n = openssh_size(decode(run[a : a + MOST * letters // size]) or b"") if named else 0
        else:
            n = der_size(decode(run[a : a + 16 * letters // size]) or b"")
        end = a + -(-n * letters // size)
        if n and end <= len(run) and (kind := structure((decode(run[a:end]) or b"")[:n])):
            found.append((a, end, kind))
            at = end
    return found


def from_hex(text: str) -> bytes:
    return bytes.fromhex(text[: len(text) // 2 * 2])


def from_base64(text: str) -> bytes | None:
    return decoded(text[:-1] if len(text) % 4 == 1 else text)


def pem_spans(text: str) -> list[tuple[int, int, str]]:
    """Armoured keys: a BEGIN line whose next armour line is the END of the same label."""
    spans, begun = [], None
    for m in PEM.finditer(text):
        if m[1] == "BEGIN":
            begun = m
        elif begun and begun[2] == m[2]:
            lines = [x.strip() for x in text[begun.end() : m.start()].split("\n")]
            data = decoded("".join(x for x in lines if ":" not in x))
            dek = next((d for x in lines if (d := DEK.fullmatch(x))), None)
            # an old-style sealed body is whole cipher blocks, as long as the initial vector
            sealed = dek and data and len(dek[2]) in (16, 32) and len(data) % (len(dek[2]) // 2) == 0
            if sealed or structure(data):
                spans.append((begun.start(), m.end(), "pem"))
            begun = None
    return spans


def names_algorithm(head: str) -> bool:
    """Whether the letters decode to a JSON object that names an algorithm."""
    try:
        spec = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(spec, dict) and isinstance(spec.get("alg"), str)


def token_spans(text: str) -> list[tuple[int, int, str]]:
    spans, ended = [], 0
    for m in TOKEN.finditer(text):
        at = m[1].find("eyJ", max(0, len(m[1]) - HEADER))
        while 0 <= at <= len(m[1]) - 11 and m.start() + at >= ended:
            if names_algorithm(m[1][at:]):
                ended = m.end(3)
                spans.append((m.start() + at, ended, "token"))
                break
            at = m[1].find("eyJ", at + 1)
    return spans


def base_spans(text: str, lower: str) -> list[tuple[int, int, str]]:
    spans = []
    if any(w in lower for w in ASSIGN_WORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def own_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates that are confirmed by their structure."""
    spans = pem_spans(text) if "-----BEGIN " in text else []
    if "eyJ" in text:
        spans += token_spans(text)
    for m in RUN.finditer(text):
        run, places = m[0], None
        if "\n" in run:
            places = [k for k, c in enumerate(run) if c not in "\r\n"]
            run = "".join(run.split())
        for a, b, kind in keys_in(run.rstrip("="), START64, 4, 3, from_base64):
            spans.append((m.start() + (places[a] if places else a), m.start() + (places[b - 1] + 1 if places else b), kind))
    for m in HEX_RUN.finditer(text):
        spans += [(m.start() + a, m.start() + b, kind) for a, b, kind in keys_in(m[0].lower(), START16, 2, 1, from_hex)]
    return spans


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], ORDER[s[2]], s[1])))


def _row(text: str) -> tuple:
    base = base_spans(text, text.lower())
    count = lambda kind: sum(s[2] == kind for s in base)
    return count("assign"), count("access"), count("hex"), hashlib.sha256(shown(base).encode()).hexdigest(), shown(base + own_spans(text))


NAMES = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def secret_scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Secrets in each whole text; no shuffle, Arrow batches of bounded bytes.

    Per input row: id_col, n_assign, n_access, n_hex, base_sha256 (of the base spans), spans (all
    spans as kind:start:end in code points). A null text counts as empty (no spans, the digest of
    the empty string); very long texts are scanned whole in time linear in them; spans that start
    together stand in the order of KINDS; repeated rows and null ids stay; an empty table gives no rows;
    other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_row(t.as_py() or "") for t in batch.column(1)]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [id_col, *NAMES])

    return map_arrow(docs.select(id_col, text), run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))
