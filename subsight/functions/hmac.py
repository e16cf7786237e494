"""HMAC-SHA256 as Catalyst expressions (no Python in the hot path).

HMAC(K, m) = H((K' xor opad) || H((K' xor ipad) || m)), with K' the key
padded to the 64-byte block (hashed first when longer). The two padded
keys depend only on the secret, so they are computed once on the driver
and enter the plan as binary literals."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def _pads(secret: str) -> tuple[str, str]:
    k = secret.encode("utf-8")
    if len(k) > BLOCK:
        k = hashlib.sha256(k).digest()
    k = k.ljust(BLOCK, b"\0")
    ipad = bytes(b ^ 0x36 for b in k)
    opad = bytes(b ^ 0x5C for b in k)
    return ipad.hex(), opad.hex()


def hmac_sha256_base64(body: Column, secret: str) -> Column:
    """base64(HMAC-SHA256(secret, utf8(body)))."""
    ipad, opad = _pads(secret)
    inner = F.unhex(F.sha2(F.concat(F.unhex(F.lit(ipad)), F.encode(body, "UTF-8")), 256))
    outer = F.sha2(F.concat(F.unhex(F.lit(opad)), inner), 256)
    return F.base64(F.unhex(outer))


def signature_ok(body: Column, signature: Column, secret: str) -> Column:
    """Computed signature equals the header value (missing header -> false)."""
    return F.coalesce(hmac_sha256_base64(body, secret) == signature, F.lit(False))
