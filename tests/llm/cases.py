"""Small tables with the awkward cases: nulls, empty and long texts, repeats, clashing column names."""
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, digest long, range int, score double, language string, _of long, of long, text_key long, starts int, _language string"


def words(seed: int, n: int, pool: int = 4000) -> list[str]:
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return ["".join(rng.choice(letters) for _ in range(2 + rng.randrange(pool) % 7)) for _ in range(n)]


def rows() -> list[tuple]:
    base = words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    passage = words(2, 70)
    texts = [
        " ".join(base), " ".join(near), " ".join(base), None, "", "one", "Two Words", "\n\t  ", " ".join(words(3, 50) + passage + words(4, 40)),
        " ".join(words(5, 30) + passage + words(6, 60)), " ".join(words(7, 3000)), "x" * 9000, "a " * 2000, "naïve Ünïcode ΑΣ text 中文 🙂 it's <|endoftext|> don't",
        " ".join(words(8, 90)), "MAIL me@site.com, 10.0.0.1 or +1 (514) 555-8389 and 4111 1111 1111 1111",
    ]
    out = [(i * 3 + 1, t, "en" if i % 2 else None, f"s{i % 2}", 0 if t is None else len(t), "k", 7, 9, 1, 0.5, "x", 1, 2, 3, 4, "y") for i, t in enumerate(texts)]
    return [*out, out[0], (None, "no id at all here", "en", *[None] * 13)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def texts(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[None] * 11) for i, t in pairs], SCHEMA)
