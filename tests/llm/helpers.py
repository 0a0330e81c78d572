import random

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sta", "vo", "we", "xy", "zan") for b in ("", "r", "t", "ling", "tor", "ne", "sk")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(100)) * (rng.random() < 0.3) for _ in range(n))


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
