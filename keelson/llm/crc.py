"""CRC-32 of decimal numbers in DuckDB's SQL, which has no such function."""

#: A table of one row, ``crc_table``: the remainder of each byte.
CRC_TABLE = (
    "SELECT list(list_reduce([b] || range(8), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(3988292384, x // 2) ELSE x // 2 END) "
    "ORDER BY b) AS crc_table FROM range(256) t(b)"
)


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, where ``crc_table`` is in scope."""
    return (
        f"xor(4294967295, list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda z: CAST(ascii(z) AS BIGINT)), "
        "lambda x, y: xor(crc_table[(xor(x, y) & 255) + 1], x // 256)))"
    )
