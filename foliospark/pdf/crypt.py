"""The standard security handler: RC4 of 40 to 128 bits, AES of 128 and 256 bits; for user passwords."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5, sha256, sha384, sha512

# fixed value: what short passwords are filled up with
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for b in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(b ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def _double(a: int) -> int:
    return (a << 1 ^ 0x11B if a & 0x80 else a << 1) & 255


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = _double(a), b >> 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    """Substitution by the inverse in the field and a turn of its bits."""
    box = [0] * 256
    for a in range(256):
        x = next((b for b in range(256) if _times(a, b) == 1), 0)
        y = 0
        for k in range(5):
            y ^= (x << k | x >> 8 - k) & 255
        box[a] = y ^ 0x63
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    return box, back


BOX, BACK = _boxes()
_BY = {m: [_times(a, m) for a in range(256)] for m in (2, 3, 9, 11, 13, 14)}


def _round_keys(key: bytes) -> list[list[int]]:
    n, words, factor = len(key) // 4, [list(key[i : i + 4]) for i in range(0, len(key), 4)], 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = [BOX[b] for b in w[1:] + w[:1]]
            w[0] ^= factor
            factor = _double(factor)
        elif n > 6 and i % n == 4:
            w = [BOX[b] for b in w]
        words.append([a ^ b for a, b in zip(words[i - n], w, strict=True)])
    return [sum(words[i : i + 4], []) for i in range(0, len(words), 4)]


def aes_decrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    keys, out = _round_keys(key), bytearray()
    turn = [(4 * ((i // 4 - i % 4) % 4) + i % 4) for i in range(16)]
    n9, n11, n13, n14 = (_BY[m] for m in (9, 11, 13, 14))
    for at in range(0, len(data) - 15, 16):
        block = data[at : at + 16]
        s = [a ^ b for a, b in zip(block, keys[-1], strict=True)]
        for k in range(len(keys) - 2, -1, -1):
            s = [BACK[s[t]] ^ keys[k][i] for i, t in enumerate(turn)]
            if k:
                s = [v for c in range(0, 16, 4) for a, b, d, e in [s[c : c + 4]] for v in (n14[a] ^ n11[b] ^ n13[d] ^ n9[e], n9[a] ^ n14[b] ^ n11[d] ^ n13[e], n13[a] ^ n9[b] ^ n14[d] ^ n11[e], n11[a] ^ n13[b] ^ n9[d] ^ n14[e])]
        out += bytes(a ^ b for a, b in zip(s, iv, strict=True))
        iv = block
    return bytes(out)


def aes_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    """Whole blocks, chained."""
    keys, out = _round_keys(key), bytearray()
    turn = [(4 * ((i // 4 + i % 4) % 4) + i % 4) for i in range(16)]
    two, three = _BY[2], _BY[3]
    for at in range(0, len(data), 16):
        s = [a ^ b ^ c for a, b, c in zip(data[at : at + 16], iv, keys[0], strict=True)]
        for k in range(1, len(keys)):
            s = [BOX[s[t]] for t in turn]
            if k < len(keys) - 1:
                s = [v for c in range(0, 16, 4) for a, b, d, e in [s[c : c + 4]] for v in (two[a] ^ three[b] ^ d ^ e, a ^ two[b] ^ three[d] ^ e, a ^ b ^ two[d] ^ three[e], three[a] ^ b ^ d ^ two[e])]
            s = [a ^ b for a, b in zip(s, keys[k], strict=True)]
        iv = bytes(s)
        out += iv
    return bytes(out)


def _unpadded(data: bytes) -> bytes:
    return data[: -data[-1]] if data and 1 <= data[-1] <= 16 else data


@dataclass
class Handler:
    key: bytes
    method: str  # RC4, AESV2, AESV3 or Identity

    def _object_key(self, num: int, gen: int) -> bytes:
        raw = self.key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if self.method == "AESV2" else b"")
        return md5(raw).digest()[: min(16, len(self.key) + 5)]

    def stream(self, data: bytes, num: int, gen: int) -> bytes:
        if self.method == "Identity":
            return data
        if self.method == "RC4":
            return rc4(self._object_key(num, gen), data)
        key = self.key if self.method == "AESV3" else self._object_key(num, gen)
        return _unpadded(aes_decrypt(key, data[16:], data[:16]))

    def strings(self, x, num: int, gen: int):
        if isinstance(x, bytes):
            return self.stream(x, num, gen)
        if isinstance(x, list):
            return [self.strings(v, num, gen) for v in x]
        if isinstance(x, dict):
            return {k: self.strings(v, num, gen) for k, v in x.items()}
        return x


def file_key(e: dict, file_id: bytes, password: bytes, length: int) -> bytes:
    raw = (password + PAD)[:32] + e["O"][:32] + (e["P"] & 0xFFFFFFFF).to_bytes(4, "little") + file_id
    if e["R"] >= 4 and e.get("EncryptMetadata") is False:
        raw += b"\xff" * 4
    key = md5(raw).digest()
    if e["R"] >= 3:
        for _ in range(50):
            key = md5(key[:length]).digest()
    return key[:length]


def user_entry(e: dict, key: bytes, file_id: bytes) -> bytes:
    """What a right key makes of the padding."""
    if e["R"] == 2:
        return rc4(key, PAD)
    out = rc4(key, md5(PAD + file_id).digest())
    for i in range(1, 20):
        out = rc4(bytes(b ^ i for b in key), out)
    return out


def hardened(password: bytes, salt: bytes, revision: int) -> bytes:
    """The hash of revisions 5 and 6 for user passwords."""
    k = sha256(password + salt).digest()
    if revision < 6:
        return k
    i, last = 0, 0
    while i < 64 or last > i - 32:
        e = aes_encrypt(k[:16], (password + k) * 64, k[16:32])
        k = (sha256, sha384, sha512)[sum(e[:16]) % 3](e).digest()
        i, last = i + 1, e[-1]
    return k[:32]


def handler(e: dict, file_id: bytes, password: bytes, get) -> Handler | None:
    """The handler for a password; None if it is wrong."""
    e = {k: get(v) for k, v in e.items()}
    if e["R"] >= 5:
        u = e["U"]
        if hardened(password[:127], u[32:40], e["R"]) != u[:32]:
            return None
        return Handler(aes_decrypt(hardened(password[:127], u[40:48], e["R"]), e["UE"], bytes(16)), "AESV3")
    method = "RC4"
    if e.get("V") == 4:
        named = get(get(e.get("CF", {})).get(e.get("StmF", "Identity"))) or {}
        method = {"V2": "RC4", "AESV2": "AESV2"}.get(named.get("CFM"), "Identity")
    length = 5 if e["R"] == 2 else 16 if e.get("V") == 4 else e.get("Length", 40) // 8
    key = file_key(e, file_id, password, length)
    n = 32 if e["R"] == 2 else 16
    return Handler(key, method) if user_entry(e, key, file_id)[:n] == e["U"][:n] else None
