"""Presented credentials: header parsing, token hashes, identity-claim triage.

Nothing here authenticates anybody: signatures are not checked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lagoon.functions.scalars import parse_number, verified_flag
from lagoon.functions.text import SPACE, trim_all


# Fixed value: the shape of the header.
BEARER = rf"(?iU)\ABearer{SPACE}+([\S\x{{85}}&&[^\x{{FEFF}}]]+)\z"


def bearer_token(header: Column) -> Column:
    """Token of a well-formed `Bearer` header, else null."""
    token = F.regexp_extract(trim_all(header), BEARER, 1)
    return F.nullif(token, F.lit(""))


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def _segment(parts: Column, index: int) -> Column:
    """Decode one base64url segment to text (null when it is not decodable)."""
    raw = F.translate(F.element_at(parts, index), "-_", "+/")
    raw = F.regexp_replace(raw, "=+$", "")
    pad = F.repeat(F.lit("="), F.pmod(F.lit(4) - F.length(raw) % 4, F.lit(4)).cast("int"))
    return F.try_to_binary(F.concat(raw, pad), F.lit("base64")).cast("string")


def identity_claims(token: Column, issuer: str, audience: str, as_of: Column) -> Column:
    """Struct (ok, reason, sub, email, email_verified) for an identity token.

    Checks run in a fixed order and the first failure names the reason:
    shape, algorithm, key id, issuer, audience (text or list), expiry, subject.
    """
    parts = F.split(token, r"\.")
    usable = F.size(parts) == 3
    head = F.when(usable, _segment(parts, 1))
    body = F.when(usable, _segment(parts, 2))
    is_json = lambda c: c.isNotNull() & F.try_parse_json(c).isNotNull()
    field = lambda c, name: F.get_json_object(c, f"$.{name}")
    # JSON text is distinguished from numbers and lists by its variant type.
    kind = lambda c, name: F.schema_of_variant(F.variant_get(F.try_parse_json(c), f"$.{name}", "variant"))

    aud = field(body, "aud")
    listed = F.coalesce(F.array_contains(F.from_json(aud, "array<string>"), audience), F.lit(False))
    aud_ok = F.when(kind(body, "aud").startswith("ARRAY"), listed).otherwise(F.coalesce(aud == audience, F.lit(False)))
    exp = parse_number(field(body, "exp"))
    sub = F.when(kind(body, "sub") == "STRING", field(body, "sub"))
    email = F.when(kind(body, "email") == "STRING", field(body, "email"))

    reason = (
        F.when(token.isNull() | ~usable, "malformed")
        .when(~(is_json(head) & is_json(body)), "malformed")
        .when(~F.coalesce(field(head, "alg") == "RS256", F.lit(False)), "wrong algorithm")
        .when(F.coalesce(field(head, "kid"), F.lit("")) == "", "no key id")
        .when(~F.coalesce(field(body, "iss") == issuer, F.lit(False)), "wrong issuer")
        .when(~aud_ok, "wrong audience")
        .when(exp.isNull() | (exp * 1000 <= F.unix_millis(as_of)), "expired")
        .when(F.coalesce(sub, F.lit("")) == "", "no subject")
    )
    ok = reason.isNull()
    return F.struct(
        ok.alias("ok"),
        reason.alias("reason"),
        F.when(ok, sub).alias("sub"),
        F.when(ok, email).alias("email"),
        F.when(ok, verified_flag(field(body, "email_verified"))).alias("email_verified"),
    )
