"""What the brute-force versions share."""

import hashlib
import zlib

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def ascii_lower(text):
    return (text or "").encode().lower().decode()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())
