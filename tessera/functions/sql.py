"""Pieces of DuckDB SQL that oracles share."""

#: The table of the reflected CRC-32 polynomial, made by its rule.
CRC_TABLE = "(SELECT list(t ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i)))"


def crc32(text: str, table: str = "tab") -> str:
    """CRC-32 of a text's UTF-8 bytes, byte by byte; table names a column with CRC_TABLE."""
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), (2 * i - 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
