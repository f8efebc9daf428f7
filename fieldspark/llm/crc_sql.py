"""CRC-32 in the SQL of the other engine, which has no such function: used by the SQL of queries alone."""

from __future__ import annotations

#: Common table expressions that make `crc_steps`, one row with the 256 remainders (t), from the reflected polynomial.
CRC_STEPS = """
crc_bits(i, k, c) AS (SELECT i, 0, CAST(i AS UBIGINT) FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS UBIGINT), c >> 1) ELSE c >> 1 END FROM crc_bits WHERE k < 8),
crc_steps AS (SELECT list(c ORDER BY i) t FROM crc_bits WHERE k = 8)"""


def crc_of(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; the statement must read crc_steps too."""
    pairs = f"regexp_extract_all(hex(encode({text})), '..')"
    steps = f"list_transform({pairs}, lambda h: CAST('0x' || h AS UBIGINT))"
    return f"CAST(xor(CAST(4294967295 AS UBIGINT), list_reduce({steps}, lambda a, x: xor(a >> 8, t[1 + CAST(xor(a, x) & 255 AS INT)]), CAST(4294967295 AS UBIGINT))) AS BIGINT)"
