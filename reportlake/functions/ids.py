"""Identifiers and checksums as columns."""

from pyspark.sql import Column, functions as F

# Fixed value: the URL namespace of UUID version 5.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
POINT_ID_PREFIX = "ubnd-kb"


def uuid5(name: Column) -> Column:
    """Version-5 UUID of a name in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def point_id(document_id: Column, chunk_id: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit(POINT_ID_PREFIX), document_id, chunk_id))


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def short_document_id(sha256: Column) -> Column:
    return F.concat(F.lit("doc-"), F.substring(sha256, 1, 16))


def managed_path(domain: Column, sha256: Column, file_name: Column) -> Column:
    """Content-addressed place of a stored file."""
    return F.concat_ws(
        "/", domain, F.substring(sha256, 1, 2), F.concat_ws("_", sha256, file_name)
    )


def combined_checksum(parts: Column) -> Column:
    """Checksum over an array of (role, sha256) structs, taken in role order."""
    ordered = F.transform(F.array_sort(parts), lambda p: F.concat(p["role"], p["sha256"]))
    return F.sha2(F.array_join(ordered, ""), 256)
