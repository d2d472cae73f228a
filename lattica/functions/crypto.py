"""Digests, encodings and passphrase wrapping as column functions."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import canonical_json, canonical_json_text

ITERATIONS, MOST_ITERATIONS = 100_000, 1_000_000


def base64url(c: Column) -> Column:
    return F.translate(F.base64(c), "+/=\r\n", "-_")


def from_base64url(c: Column) -> Column:
    plain = F.translate(c, "-_", "+/")
    return F.unbase64(F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)))))


def hex_soul(soul: Column) -> Column:
    """Whether a soul is a public key: 64 hex digits."""
    return soul.rlike("^[0-9a-fA-F]{64}$")


def batch_nonce(fields_json: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the canonical JSON of the fields."""
    return F.substring(F.sha2(canonical_json(fields_json), 256), 1, 16)


def work_digest(fields_json: Column, ts: Column) -> Column:
    """SHA-256 of the canonical JSON of {fields, ts}; ts is JSON text of a number."""
    return F.sha2(canonical_json(F.concat(F.lit('{"fields":'), fields_json, F.lit(',"ts":'), ts, F.lit("}"))), 256)


def work_hash(soul: Column, message: Column, digest: Column, nonce: Column) -> Column:
    return F.sha2(F.concat_ws(":", soul, message, digest, nonce.cast("string")), 256)


def work_done(hashed: Column, difficulty: Column | int) -> Column:
    """Whether a hash begins with at least difficulty zeros."""
    return F.length(F.regexp_extract(hashed, "^(0*)", 1)) >= difficulty


def solve_work(soul: Column, message: Column, digest: Column, difficulty: int, most: int = 5_000_000) -> Column:
    """The least nonce that does the work; null if none below most does."""

    @F.pandas_udf("long")
    def solve(souls: pd.Series, messages: pd.Series, digests: pd.Series) -> pd.Series:
        def one(s, m, d):
            head, want = hashlib.sha256(f"{s}:{m}:{d}:".encode()), "0" * difficulty
            for nonce in range(most):
                h = head.copy()
                h.update(str(nonce).encode())
                if h.hexdigest().startswith(want):
                    return nonce
            return None

        return pd.Series([one(*x) for x in zip(souls, messages, digests, strict=True)], dtype="Int64")

    return solve(soul, message, digest)


def _derived(passphrase: Column, salt: Column, iterations: Column) -> Column:
    """The key; null for an empty passphrase and for iterations out of bounds."""

    def one(w, s, n):
        if not w or s is None or n is None or not 1 <= n <= MOST_ITERATIONS:
            return None
        return hashlib.pbkdf2_hmac("sha256", unicodedata.normalize("NFC", w).encode(), bytes(s), int(n))

    @F.pandas_udf("binary")
    def derive(words: pd.Series, salts: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([one(w, s, n) for w, s, n in zip(words, salts, ns, strict=True)], dtype=object)

    return derive(passphrase, salt, iterations.cast("double"))


def wrap(secret: Column, passphrase: Column, salt: Column, iv: Column, iterations: int = ITERATIONS) -> Column:
    """AES-256-GCM under a PBKDF2 key: struct of base64url salt, iv and ct, and the iterations."""
    if not 1 <= iterations <= MOST_ITERATIONS:
        raise ValueError("iterations out of bounds")
    sealed = F.aes_encrypt(secret, _derived(passphrase, salt, F.lit(iterations)), F.lit("GCM"), F.lit("DEFAULT"), iv)
    return F.struct(base64url(salt).alias("salt"), base64url(iv).alias("iv"), base64url(F.substring(sealed, 13, 1 << 30)).alias("ct"), F.lit(iterations).alias("iterations"))


def unwrap(wrapped: Column, passphrase: Column) -> Column:
    """The secret, or null where passphrase or data are wrong or the iterations stored are out of bounds; without any they are ITERATIONS."""
    data = F.concat(from_base64url(wrapped["iv"]), from_base64url(wrapped["ct"]))
    iterations = F.coalesce(wrapped["iterations"], F.lit(ITERATIONS))
    return F.try_aes_decrypt(data, _derived(passphrase, from_base64url(wrapped["salt"]), iterations), F.lit("GCM"))


def tagged_label(kind: str, text: Column) -> Column:
    """Labels that keep kinds apart: '0', 0, false and null differ."""
    return F.concat(F.lit(f"{kind}:"), F.coalesce(text.cast("string"), F.lit("")))


# Ed25519 verification (RFC 8032). The field, the group order, the curve and its base point.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)


def _x_of(y: int, odd: int) -> int | None:
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (x == 0 and odd):
        return None
    return P - x if x & 1 != odd else x


def _add(a, b):
    (x1, y1, z1, t1), (x2, y2, z2, t2) = a, b
    u, v = (y1 - x1) * (y2 - x2) % P, (y1 + x1) * (y2 + x2) % P
    w, z = 2 * t1 * t2 * D % P, 2 * z1 * z2 % P
    e, f, g, h = v - u, z - w, z + w, v + u
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(k: int, point):
    out = (0, 1, 1, 0)
    while k:
        if k & 1:
            out = _add(out, point)
        point = _add(point, point)
        k >>= 1
    return out


def _point(raw: bytes):
    y = int.from_bytes(raw, "little")
    odd, y = y >> 255, y & (1 << 255) - 1
    x = _x_of(y, odd) if y < P else None
    return None if x is None else (x, y, 1, x * y % P)


BASE_POINT = _point((4 * pow(5, P - 2, P) % P).to_bytes(32, "little"))


def verified(public: bytes, message: bytes, signature: bytes) -> bool:
    """Whether an Ed25519 signature holds; malformed input is False."""
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(public), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    k = int.from_bytes(hashlib.sha512(signature[:32] + public + message).digest(), "little") % ORDER
    left, right = _times(s, BASE_POINT), _add(r, _times(k, a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0


def _packed(point) -> bytes:
    x, y, z, _ = point
    inverse = pow(z, P - 2, P)
    x, y = x * inverse % P, y * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _scalar(raw: bytes) -> int:
    """A secret scalar: the lowest three bits clear, the highest two 0 and 1."""
    return int.from_bytes(raw, "little") & ((1 << 254) - 8) | 1 << 254


def public_key(seed: bytes) -> bytes:
    return _packed(_times(_scalar(hashlib.sha512(seed).digest()[:32]), BASE_POINT))


def signed(seed: bytes, message: bytes) -> bytes:
    """The Ed25519 signature of a message under a seed of 32 bytes."""
    whole = hashlib.sha512(seed).digest()
    a, public = _scalar(whole[:32]), public_key(seed)
    r = int.from_bytes(hashlib.sha512(whole[32:] + message).digest(), "little") % ORDER
    point = _packed(_times(r, BASE_POINT))
    k = int.from_bytes(hashlib.sha512(point + public + message).digest(), "little") % ORDER
    return point + ((r + k * a) % ORDER).to_bytes(32, "little")


def sign(seed: Column, message: Column) -> Column:
    """Hex signatures of messages under seeds (binary, 32 bytes); null for others."""

    @F.pandas_udf("string")
    def run(seeds: pd.Series, messages: pd.Series) -> pd.Series:
        return pd.Series([signed(bytes(s), m.encode()).hex() if s is not None and m is not None and len(s) == 32 else None for s, m in zip(seeds, messages, strict=True)], dtype=object)

    return run(seed, message)


#: What a signature doesn't cover.
UNSIGNED = ("id", "sender", "signature", "_hops")


def signed_text(raw: Column) -> Column:
    """What the signature of a message (JSON text) covers: the canonical JSON of all but UNSIGNED; null for what is no object."""

    def one(t):
        try:
            body = json.loads(t)
        except (TypeError, ValueError):
            return None
        return canonical_json_text({k: v for k, v in body.items() if k not in UNSIGNED}) if isinstance(body, dict) else None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(raw)


def verify(public_hex: Column, message: Column, signature_hex: Column) -> Column:
    """Whether each signature holds; never null, never an error."""

    @F.pandas_udf("boolean")
    def run(keys: pd.Series, messages: pd.Series, signatures: pd.Series) -> pd.Series:
        def one(p, m, s):
            try:
                return verified(bytes.fromhex(p), m.encode(), bytes.fromhex(s))
            except (AttributeError, TypeError, ValueError):
                return False

        return pd.Series([one(*x) for x in zip(keys, messages, signatures, strict=True)])

    return run(public_hex, message, signature_hex)
