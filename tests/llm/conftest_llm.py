"""Constants and helpers of these tests."""

import hashlib

SMALL = "/root/testdata/sf0.01"


def sha256(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()
