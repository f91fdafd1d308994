"""Hash algebra as native column expressions, for primes up to 2**61 - 1.

Products of two numbers below 2**61 fit DECIMAL(38); Horner steps over as many bytes (four at most) as keep the base's power
below 2**30 stay within BIGINT, and take one byte at a time in decimals where a single base does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import M61, HashSpec

BITS = 62  # of lengths and repeat counts


def _c(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def _once(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mod_mul(a: Column | int, b: Column | int, prime: int = M61) -> Column:
    """a * b mod p of two non-negative longs below p."""
    return (_c(a).cast("decimal(19,0)") * _c(b).cast("decimal(19,0)") % F.lit(prime).cast("decimal(19,0)")).cast("long")


def mod_add(a: Column | int, b: Column | int, prime: int = M61) -> Column:
    return (_c(a) + _c(b)) % F.lit(prime)


def mod_sub(a: Column | int, b: Column | int, prime: int = M61) -> Column:
    return F.pmod(_c(a) - _c(b), F.lit(prime))


def mod_reduce(a: Column, prime: int = M61) -> Column:
    """Any non-negative DECIMAL(38,0) modulo p."""
    return (a.cast("decimal(38,0)") % F.lit(prime).cast("decimal(38,0)")).cast("long")


def power(base: int, n: Column | int, prime: int = M61) -> Column:
    """base ** n mod p: the product of the squares whose bit is set in n."""
    squares, x = [], base % prime
    for _ in range(BITS):
        squares.append(x)
        x = x * x % prime
    table = F.array(*[F.lit(s) for s in squares])

    def of(n: Column) -> Column:
        used = F.filter(table, lambda x, i: F.call_function("getbit", n, i) == 1)
        return F.aggregate(used, F.lit(1).cast("long"), lambda acc, x: mod_mul(acc, x, prime))

    return _once(_c(n), of)


def phi(q: Column | int, alpha: Column | int, prime: int = M61) -> Column:
    """1 + alpha + ... + alpha**(q - 1) mod p; 0 for q = 0."""
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(1).cast("long").alias("p"))

    def of(a: Column) -> Column:
        q, alpha = a["q"], a["a"]
        bits = F.transform(F.sequence(F.lit(BITS - 1), F.lit(0), F.lit(-1)), lambda i: F.struct(F.call_function("getbit", q, i).alias("b")))

        def step(acc: Column, x: Column) -> Column:
            s = mod_mul(acc["s"], mod_add(acc["p"], 1, prime), prime)
            p = mod_mul(acc["p"], acc["p"], prime)
            return F.when(x["b"] == 1, F.struct(mod_add(mod_mul(s, alpha, prime), 1, prime).alias("s"), mod_mul(p, alpha, prime).alias("p"))).otherwise(F.struct(s.alias("s"), p.alias("p")))

        return F.aggregate(bits, start, step, lambda acc: acc["s"])

    return _once(F.struct(_c(q).alias("q"), _c(alpha).alias("a")), of)


def _number(data: Column, at: Column, size: int) -> Column:
    """The number that ``size`` bytes from ``at`` make; a slice of a binary costs its own length only."""
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(size))), 16, 10).cast("long")


def byte_values(data: Column) -> Column:
    """Bytes of a binary as an array of ints, [] where it is empty."""
    values = lambda d: F.transform(F.sequence(F.lit(0), F.octet_length(d) - 1), lambda i: _number(d, i, 1).cast("int"))
    return F.when(F.octet_length(data) == 0, F.array().cast("array<int>")).otherwise(_once(data, values))


def _small_mul(h: Column, m: int, prime: int) -> Column:
    """h * m mod 2**61 - 1 within BIGINT, m below 2**30."""
    high, low = F.shiftright(h, 31) * F.lit(m).cast("long"), h.bitwiseAND(F.lit((1 << 31) - 1)) * F.lit(m).cast("long")
    return F.shiftright(high, 30) + F.shiftleft(high.bitwiseAND(F.lit((1 << 30) - 1)), 31) % F.lit(prime) + low % F.lit(prime)


def poly_hash(data: Column, base: int = 131, prime: int = M61) -> Column:
    """H of a binary column; null of null, 0 of the empty string."""
    size = max((g for g in range(1, 5) if base**g < 1 << 30), default=0)  # bytes of a step within BIGINT
    if prime == M61 and size:
        byte = lambda v, k: F.shiftright(v, 8 * k).bitwiseAND(F.lit(255)) + 1
        group = lambda v, size: sum((byte(v, size - 1 - k) * F.lit(base ** (size - 1 - k)).cast("long") for k in range(size)), F.lit(0).cast("long"))
        step = lambda h, v: (_small_mul(h, base**size, prime) + group(v, size)) % F.lit(prime)

        def of(d: Column) -> Column:
            n = F.octet_length(d)
            first = n % size  # bytes before the groups
            head = F.lit(0).cast("long")
            for k in range(1, size):
                head = F.when(first == k, group(_number(d, F.lit(0), k), k)).otherwise(head)
            groups = F.when(n >= size, F.transform(F.sequence(F.lit(0), F.floor(n / size).cast("int") - 1), lambda i: _number(d, first + i * size, size))).otherwise(F.array().cast("array<bigint>"))
            return F.aggregate(groups, head, step)

        # bound once: inside a lambda an expression over the column would be worked out for every group
        out = _once(data, of)
    else:
        step = lambda h, c: mod_add(mod_mul(h, base, prime), c.cast("long") + 1, prime)
        out = F.aggregate(byte_values(data), F.lit(0).cast("long"), step)
    return F.when(data.isNotNull(), out)


def multi_hash(data: Column, spec: HashSpec) -> Column:
    """The k hashes of a binary column as an array."""
    return F.when(data.isNotNull(), F.array(*[poly_hash(data, b, spec.prime) for b in spec.bases]))


def hash_concat(a: Column, b: Column, len_b: Column, base: int = 131, prime: int = M61) -> Column:
    """H of A followed by B."""
    return mod_add(mod_mul(a, power(base, len_b, prime), prime), b, prime)


def hash_repeat(h: Column, length: Column, q: Column | int, base: int = 131, prime: int = M61) -> Column:
    """H of a string of this hash and length, q times over."""
    return mod_mul(h, phi(q, power(base, length, prime), prime), prime)


def hash_overlap(h: Column, d: Column, length: Column, h_rest: Column, base: int = 131, prime: int = M61) -> Column:
    """H of the first ``length`` bytes of a period of d bytes; h_rest is that of its first length % d bytes."""
    whole = hash_repeat(h, d, F.floor(length / d).cast("long"), base, prime)
    return hash_concat(whole, h_rest, length % d, base, prime)


def substring_hash(prefix_start: Column, prefix_end: Column, length: Column, base: int = 131, prime: int = M61) -> Column:
    """H of the bytes between two prefixes whose hashes are given; 0 for no bytes."""
    return F.when(length == 0, F.lit(0).cast("long")).otherwise(mod_sub(prefix_end, mod_mul(prefix_start, power(base, length, prime), prime), prime))


def each(f, *arrays: Column, spec: HashSpec, **given) -> Column:
    """A k-tuple operation: f for each base, on the tuples' elements."""
    return F.array(*[f(*[a[i] for a in arrays], base=b, prime=spec.prime, **given) for i, b in enumerate(spec.bases)])


def format_hash(h: Column, as_hex: bool = False) -> Column:
    """Decimal digits, or lower-case hexadecimal ones without leading zeros."""
    return F.lower(F.hex(h)) if as_hex else h.cast("string")


def printable(byte: Column) -> Column:
    """The character of a byte from 32 to 126, else null."""
    return F.when(byte.between(32, 126), F.chr(byte.cast("int")))


def detect_format(content: Column) -> Column:
    """Format by magic bytes: null for fewer than four bytes or none that is known."""
    magic = F.hex(F.substring(content, 1, 4))
    # Magic bytes of the public formats.
    return (
        F.when(F.octet_length(content) < 4, F.lit(None).cast("string"))
        .when(magic == "04224D18", "lz4_frame")
        .when(magic == "28B52FFD", "zstd")
        .when(F.substring(magic, 1, 4) == "1F8B", "gzip")
    )


def resolve_format(content: Column, asked: Column) -> Column:
    """The format asked for; where that is null or auto, the detected one; else raw."""
    return F.coalesce(F.nullif(asked, F.lit("auto")), detect_format(content), F.lit("raw"))


def compression_ratio(decoded: Column, stored: Column) -> Column:
    """decoded / stored to two places, halves to even; 0 where nothing is stored."""
    return F.when(stored > 0, F.bround(decoded.cast("double") / stored, 2)).otherwise(F.lit(0.0))
