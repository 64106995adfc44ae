import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pagefold.llm import sanitise as S

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(map(int, str(2 * d)))
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end(), m[0]) for k in RULES for m in re.finditer(RULES[k], text or "") if holds(k, m[0])]


def card(rng):
    digits = [rng.randrange(10) for _ in range(15)]
    return next(c for c in ("".join(map(str, digits)) + str(i) for i in range(10)) if luhn(c))


def odd_texts():
    rng = random.Random(9)
    alphabet = ["@", ".", "1", "23", "+", "-", " ", "a", "B.c", "_", "(", ")", "é", "😀", "256", "0001", "\n", "192.168.0.1", "a@b.c", "%"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += ["".join(rng.choice("0123456789 -+.") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += [None, "", "x@y.z" * 50, "a@b.c_d@e.f,g@h.i..j@k.l", "1.2.3.4.5.6.7.8", "1.2.3.4567.8.9.10", "000255.1.1.1 256.1.1.1",
              f"card {card(rng)} and {' '.join(card(rng)[i:i + 4] for i in range(0, 16, 4))}", "+1 (319) 555-5132", "+1 (319) 555", "+1" + " " * 900,
              "a@b" + ".c" * 300, "1 " * 400, "@" * 500, "+1 " * 200, "a" * 400, "1" * 400]
    return texts


def test_base_spans(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(4)
    got = {r["doc_id"]: r for r in S.sanitise(df).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        assert got[i]["base_spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e, _ in want), t[:80]
        assert [got[i][f"n_{k}"] for k in RULES] == [sum(w[0] == k for w in want) for k in RULES]
        assert got[i]["spans"].startswith(got[i]["base_spans"])
        if not want:
            assert got[i]["sanitised"] == t and got[i]["spans"] == ""


def test_long_runs(spark):
    """Plain patterns would take the square of the length on these."""
    texts = {"a" * 300_000: "", "1" * 300_000: "", "a@b" + ".c" * 50_000: "email:0:100003", "1 " * 40_000: "", "@" * 50_000: "", "+1 " * 20_000: "",
             "a@b.c " * 2_000: ",".join(f"email:{6 * i}:{6 * i + 5}" for i in range(2_000)), "1." * 99_999 + "x": ",".join(
                 f"ip:{8 * i}:{8 * i + 7}" for i in range(24_999))}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r["text"]: r["spans"] for r in S.sanitise(df).select("text", "spans").collect()} == texts


def telling(texts, support, disclosed, context=S.CONTEXT):
    """entity -> terms that disclose it, by the definition."""
    texts = {t for t in texts if t is not None}
    word = re.compile(r"[^\W\d_]{3,}")
    n_term, n_entity, both = Counter(), Counter(), Counter()
    classes = lambda ws: ws | {w[:3] + "*" for w in ws}
    for t in texts:
        n_term.update(classes(set(word.findall(t.lower()))))
        near = defaultdict(set)
        for kind in RULES:
            found = [m for m in re.finditer(RULES[kind], t)]
            for j, m in enumerate(found):
                if not holds(kind, m[0]):
                    continue
                left, right = found[j - 1].end() if j else 0, found[j + 1].start() if j + 1 < len(found) else len(t)
                near[m[0].lower()] |= {w[0].lower() for w in word.finditer(t) if max(left, m.start() - context) <= w.start() and w.end() <= m.start()
                                       or m.end() <= w.start() and w.end() <= min(right, m.end() + context)}
        for e, ws in near.items():
            n_entity[e] += 1
            both.update((e, w) for w in classes(ws))
    n = len(texts)
    discloses = {k for k, v in both.items() if v >= support and
                 math.log(n * v / (n_entity[k[0]] * n_term[k[1]])) >= disclosed * math.log(n / n_entity[k[0]])}
    out = defaultdict(dict)
    for e, t in discloses:
        if not t.endswith("*"):
            stem = t[:3] + "*"
            out[e][t] = "" if (e, stem) in discloses else stem
    return out


def corpus():
    rng = random.Random(4)
    common = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    text = lambda n: [rng.choice(common) for _ in range(n)]
    docs = [" ".join(text(30)) for _ in range(200)]
    for i in range(8):
        docs.append(" ".join(text(40) + ["Quentin", "Abernathy", f"reach q.abernathy@mail0.example.com", "or", "abcdezzz"] + text(40) + ["Abernathy"]))
    docs += [docs[-1]] * 5 + ["Abernathy elsewhere", "the abcdef class", "abcxyz more"] + [None, ""]
    docs += [" ".join(text(9) + ["solitary", "+44 20 7946 0958"] + text(9))] * 4  # copies are one text
    return docs


def test_terms_that_disclose_an_entity(spark):
    docs = corpus()
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    want, word = telling(docs, 3, 0.9), re.compile(r"[^\W\d_]{3,}")
    assert set(want["q.abernathy@mail0.example.com"]) >= {"quentin", "abernathy", "reach"}
    assert not any("solitary" in v for v in want.values())
    got = {r["doc_id"]: r for r in S.sanitise(rows).collect()}
    for i, t in enumerate(docs):
        own = base(t)
        terms = {w: k for e in own for w, k in want.get(e[3].lower(), {}).items()}
        for e in own:  # removed for one entity, removed
            terms.update({w: "" for w, k in want.get(e[3].lower(), {}).items() if not k})
        spans = [(m.start(), m.end(), terms[m[0].lower()]) for m in word.finditer(t or "") if m[0].lower() in terms
                 and not any(m.start() < e[2] and e[1] < m.end() for e in own)]
        assert got[i]["n_term"] == len(spans)
        assert got[i]["spans"] == ",".join([f"{k}:{s}:{e}" for k, s, e, _ in own] + [f"term:{s}:{e}" for s, e, _ in spans])
        if own or spans:
            shown, done = "", 0
            for s, e, x in sorted([(s, e, f"[{k.upper()}]") for k, s, e, _ in own] + spans):
                shown, done = shown + t[done:s] + x, e
            assert got[i]["sanitised"] == shown + t[done:]
    assert "Abernathy" not in got[200]["sanitised"] and got[213]["sanitised"] == "Abernathy elsewhere"


def test_each_text_once_without_sending_texts(spark):
    texts = ["one", "two", "one", None, "", "two", "three" * 50] * 700
    rows = S._written(spark.createDataFrame([(t,) for t in texts], "_text string").repartition(3))
    met = S._each_text_once(rows.where("_text IS NOT NULL").withColumn("text_id", F.xxhash64("_text", F.length("_text"))))
    assert sorted(r["_text"] for r in met.collect()) == ["", "one", "three" * 50, "two"]
    plan = met._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.split("Initial Plan")[-1].splitlines() if "Exchange" in line]
    assert len(sent) == 2 and all("text_id#" in line or "_block#" in line for line in sent)  # row numbers by text and by block


def test_empty_table_and_native_plan(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.sanitise(df).collect() == []
    out = S.sanitise(spark.createDataFrame([(1, "call +1 (319) 555-5132", 3)], "doc_id long, text string, n_ip int"))
    assert out.columns == ["doc_id", "text", "n_email", "n_ip", "n_card", "n_phone", "n_term", "base_spans", "spans", "sanitised"]
    assert [r["sanitised"] for r in out.collect()] == ["call [PHONE]"]
    plan = out.select(F.col("*"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_running_sums(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        df = spark.createDataFrame([([3 * x for x in range(1, n + 1)],)], "lengths array<bigint>")
        assert S._with_sums(df, "lengths", "sums").first()["sums"] == [3 * i * (i + 1) // 2 for i in range(1, n + 1)]
