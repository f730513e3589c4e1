"""Content hashes: text leaves, framed leaves, line ranges, whole files (hashed twice), fingerprints of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "sha256:"
#: Fixed value: a stored hash that stands for "not computed yet".
PLACEHOLDER = "sha256:placeholder"
#: Tag before framed leaves and folder of side paths; both name a store's format, so they are parameters.
LEAF_DOMAIN = "layered-repo:leaf:v1"
DIVERGENCE_ROOT = ".layers/divergence/"


def prefixed(hex_digest: Column) -> Column:
    return F.concat(F.lit(PREFIX), hex_digest)


def text_hash(text: Column) -> Column:
    """Hash of a text leaf: its UTF-8 bytes, without a domain tag."""
    return prefixed(F.sha2(text, 256))


def file_hash(content: Column) -> Column:
    """Hash of a whole file: the digest is hashed again."""
    return prefixed(F.sha2(F.unhex(F.sha2(content, 256)), 256))


def framed(part: Column) -> Column:
    """A byte string behind its length as an unsigned 64-bit big-endian number."""
    raw = F.encode(part, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")), raw)


def leaf_hash(kind: str, *parts: Column, domain: str = LEAF_DOMAIN) -> Column:
    """Hash of a comment or processing instruction leaf; a missing part counts as empty."""
    head = F.unhex(F.lit((domain.encode() + b"\0" + kind.encode() + b"\0").hex()))
    return prefixed(F.sha2(F.concat(head, *[framed(F.coalesce(p, F.lit(""))) for p in parts]), 256))


def is_valid(h: Column) -> Column:
    """Whether a text is a prefixed hash of 64 hexadecimal digits."""
    return F.coalesce(h.rlike("^sha256:[0-9a-fA-F]{64}$"), F.lit(False))


def is_eligible(h: Column) -> Column:
    """Whether a stored hash takes part in drift checks."""
    return F.coalesce(h.startswith(PREFIX) & (h != PLACEHOLDER), F.lit(False))


def name_hash32(name: Column) -> Column:
    """Rotate-xor-multiply hash of the UTF-8 bytes, modulo 2**32."""
    digits = F.hex(F.encode(name, "UTF-8"))
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    turned = lambda h: F.shiftleft(h, 5).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.shiftright(h, 27))
    # The product of two 32-bit numbers is taken in two halves, as a long would overflow.
    times = lambda x: F.pmod(x.bitwiseAND(F.lit(0xFFFF)) * 0x9E3779B9 + F.shiftleft(F.pmod(F.shiftright(x, 16) * 0x9E3779B9, F.lit(1 << 16)), 16), F.lit(1 << 32))
    steps = F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda h, i: times(turned(h).bitwiseXOR(byte(i))))


def divergence_path(path: Column, ancestor: Column, ours: Column, theirs: Column, root: str = DIVERGENCE_ROOT) -> Column:
    """Side path of a conflict: the path, then eight bytes of the hash over the three versions' raw hashes."""
    raw = F.concat(*[F.unhex(F.replace(h, F.lit(PREFIX), F.lit(""))) for h in (ancestor, ours, theirs)])
    return F.concat(F.lit(root), path, F.lit("."), F.substring(F.sha2(raw, 256), 1, 16))
