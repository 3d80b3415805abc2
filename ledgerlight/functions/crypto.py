"""Pseudonyms, seals, marks and signatures."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import json
import unicodedata
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: Kinds of identifiers that have a key of their own.
DOMAINS = ("subject", "name", "account", "wallet", "device", "network")


def hkdf(root: bytes, info: bytes, length: int = 32, salt: bytes = b"") -> bytes:
    """RFC 5869 with SHA-256."""
    key = hmac.new(salt or b"\0" * 32, root, hashlib.sha256).digest()
    out, block, i = b"", b"", 1
    while len(out) < length:
        block = hmac.new(key, block + info + bytes([i]), hashlib.sha256).digest()
        out, i = out + block, i + 1
    return out[:length]


def canonical(domain: str, value: str | None) -> str:
    text = unicodedata.normalize("NFKC", value or "").strip()
    return " ".join(text.lower().split()) if domain == "name" else text


class Vault:
    """Keys of one organisation, from a root of at least 32 bytes."""

    def __init__(self, org: str, root: bytes):
        if len(root) < 32 or not org:
            raise ValueError("an organisation and 32 bytes of key are needed")
        self.org, self.root = org, root

    def key(self, purpose: str) -> bytes:
        return hkdf(self.root, f"{self.org}|{purpose}".encode())

    def pseudonym(self, domain: str, value: Column) -> Column:
        """domain:hex of 16 bytes, the same for equal values of one organisation and domain; null for blank ones."""
        if domain not in DOMAINS:
            raise ValueError(f"unknown domain {domain}")
        key = self.key("pseudonym/" + domain)

        @F.pandas_udf(StringType())
        def make(values: pd.Series) -> pd.Series:
            texts = values.map(lambda v: canonical(domain, v))
            return texts.map(lambda t: f"{domain}:{hmac.new(key, t.encode(), hashlib.sha256).hexdigest()[:32]}" if t else None)

        return make(value)

    def _aad(self, slot: str) -> str:
        return f"{self.org}|{slot}"

    def seal(self, slot: str, plain: Column) -> Column:
        """AES-256-GCM, bound to organisation and slot, in the JVM."""
        return F.aes_encrypt(plain, F.lit(self.key("seal")), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(self._aad(slot)))

    def open(self, slot: str, sealed: Column) -> Column:
        """Null if the bytes are not a seal of this slot."""
        return F.try_aes_decrypt(sealed, F.lit(self.key("seal")), F.lit("GCM"), F.lit("DEFAULT"), F.lit(self._aad(slot)))

    def fingerprint(self, slot: str, plain: Column) -> Column:
        key, aad = self.key("fingerprint"), self._aad(slot).encode()

        @F.pandas_udf(StringType())
        def make(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if v is None else hmac.new(key, aad + b"\0" + (v if isinstance(v, bytes) else str(v).encode()), hashlib.sha256).hexdigest())

        return make(plain)


def json_mark(text: str) -> str:
    """The same for JSON texts that differ in white space and order of keys alone."""
    try:
        body = json.dumps(json.loads(text, parse_float=str), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    except ValueError:
        body = text.encode()
    return hashlib.sha256(body).hexdigest()


@F.pandas_udf(StringType())
def mark(body: pd.Series) -> pd.Series:
    return body.map(lambda t: None if t is None else json_mark(t))


def fnv1a(data: bytes, bits: int = 64) -> int:
    """The public FNV offsets and primes."""
    h, prime = (0xCBF29CE484222325, 0x100000001B3) if bits == 64 else (0x811C9DC5, 0x01000193)
    for b in data:
        h = ((h ^ b) * prime) & ((1 << bits) - 1)
    return h


def fnv1a_many(texts: list[bytes], few: int = 32) -> np.ndarray:
    """fnv1a() of each, a byte of all of them at a time; the last few that are longer than the others one by one."""
    sizes = np.array([*map(len, texts)], np.int64)
    order = np.argsort(-sizes, kind="stable")
    data, starts, sizes = np.frombuffer(b"".join(texts), np.uint8), (np.cumsum(sizes) - sizes)[order], sizes[order]
    h, prime = np.full(len(texts), 0xCBF29CE484222325, np.uint64), 0x100000001B3
    i, n = 0, int(np.count_nonzero(sizes))
    while n > few:
        h[:n] = (h[:n] ^ data[starts[:n] + i]) * np.uint64(prime)
        i += 1
        n = int(np.searchsorted(-sizes, -i, "left"))
    for k in range(n):
        one = int(h[k])
        for b in data[starts[k] + i : starts[k] + sizes[k]].tobytes():
            one = ((one ^ b) * prime) & 0xFFFFFFFFFFFFFFFF
        h[k] = one
    out = np.empty_like(h)
    out[order] = h
    return out


@F.pandas_udf(BooleanType())
def below_line(tx_id: pd.Series, rate: pd.Series) -> pd.Series:
    """Whether a transaction is in the sample of unremarkable ones."""
    return pd.Series([fnv1a((t or "").encode(), 32) % (1 << 20) < r * (1 << 20) for t, r in zip(tx_id, rate)])


def sign(body: bytes, secret: str) -> str:
    return hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def verify(body: bytes, secret: str, signature: str) -> bool:
    return hmac.compare_digest(sign(body, secret), signature)


def valid_webhook(url: str) -> bool:
    """https to a host that is no local name and no private address."""
    parts = urlsplit(url)
    if parts.scheme != "https" or not parts.hostname or parts.username:
        return False
    try:
        return ipaddress.ip_address(parts.hostname).is_global
    except ValueError:
        return "." in parts.hostname and not parts.hostname.endswith((".local", ".internal", ".localhost"))
