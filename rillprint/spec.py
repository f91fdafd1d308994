"""What a content hash is: a prime of the form 2**k - 1 and one base or several.

H(s) = sum((s_i + 1) * x**(n - 1 - i)) mod p, 0 for the empty string.
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the hash definition.
M61 = (1 << 61) - 1
M127 = (1 << 127) - 1
DEFAULT_BASE = 131
DEFAULT_BASES = (131, 257)

#: Exponents of all Mersenne primes up to 2**127 - 1.
MERSENNE_EXPONENTS = (2, 3, 5, 7, 13, 17, 19, 31, 61, 89, 107, 127)


@dataclass(frozen=True)
class HashSpec:
    """Bases and prime; one base gives a number, several give a tuple with the collision bounds multiplied."""

    bases: tuple[int, ...] = (DEFAULT_BASE,)
    prime: int = M61

    def __post_init__(self):
        object.__setattr__(self, "bases", tuple(self.bases))
        if self.prime not in {(1 << k) - 1 for k in MERSENNE_EXPONENTS}:
            raise ValueError(f"{self.prime} is not a Mersenne prime up to 2**127 - 1")
        if not self.bases:
            raise ValueError("at least one base is needed")
        if any(not 2 <= b < self.prime for b in self.bases):
            raise ValueError("a base must be at least 2 and less than the prime")
        if len(set(self.bases)) < len(self.bases):
            raise ValueError("bases must differ")

    @property
    def k(self) -> int:
        return len(self.bases)

    @property
    def zero(self) -> tuple[int, ...]:
        return (0,) * self.k

    @property
    def is_long(self) -> bool:
        """Whether values fit a BIGINT; others are carried as 16-byte big-endian binaries."""
        return self.prime <= M61

    def collision_bound(self, length: int) -> float:
        """Chance that two given different strings of this length agree, over random bases."""
        return (length / self.prime) ** self.k
