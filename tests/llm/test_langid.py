import zlib

import numpy as np
import pytest

from ledgermatch.llm import langid

TEXTS = {
    "en": ["the house and the garden of the king", "what is the thing that they thought", "with the other hand"],
    "de": ["der könig und das haus für die straße", "nicht schön aber schnell geschrieben", "eine große übung"],
    "ru": ["дом и сад короля стоят здесь", "это было очень хорошо", "большая книга лежит"],
}


@pytest.fixture(scope="module")
def model():
    texts = [t for ts in TEXTS.values() for t in ts]
    return langid.fit_languages(texts, [g for g, ts in TEXTS.items() for _ in ts], landmarks=2)


def grams(text, alphabet):
    """Distinct n-grams, each character as itself, ``*`` for rare letters, a blank for boundaries."""
    s, out = " ", set()
    for c in text.lower():
        c = c if ord(c) in alphabet else "*" if (c.isalpha() if ord(c) < 128 else True) else " "
        if c != " " or s[-1] != " ":
            s += c
    if s[-1] != " ":
        s += " "
    for n in (1, 2, 3):
        out |= {s[i : i + n] for i in range(len(s) - n + 1)}
    return out


@pytest.mark.parametrize("text", ["a", "The  cat, the DOG!", "schön 12 über-alles", "наш дом", "数 数 数", "x" * 50, "!!!"])
def test_presence_counts_distinct_grams(model, text):
    found = model.grams.distinct(text)
    assert len(found) == len(set(found.tolist())) == len(grams(text, set(model.grams.alphabet.tolist())))


def test_long_texts_in_steps(model):
    text = "the house and könig дом " * 30_000
    assert set(model.grams.distinct(text).tolist()) == set(model.grams.distinct("the house and könig дом " * 3).tolist())


def test_score_equals_the_kernel(model):
    """One product of presence and weights is the Nyström regression on explicit kernels."""
    text = "the straße of the дом"
    marks = [t for ts in TEXTS.values() for t in ts[:2]]
    alphabet = set(model.grams.alphabet.tolist())
    sets = [grams(t, alphabet) for t in marks]

    def kernel(a, b):
        return len(a & b) / np.sqrt(len(a) * len(b))

    among = np.array([[kernel(a, b) for b in sets] for a in sets])
    texts = [t for ts in TEXTS.values() for t in ts]
    rows = np.array([[kernel(grams(t, alphabet), b) for b in sets] for t in texts])
    value, vector = np.linalg.eigh(among)
    good = value > 1e-8 * value.max()
    nystrom = vector[:, good] / np.sqrt(value[good])
    x = rows @ nystrom
    names = sorted(TEXTS)
    langs = [g for g, ts in TEXTS.items() for _ in ts]
    target = np.array([[1.0 if g == n else -1.0 for n in names] for g in langs])
    centre, middle = x.mean(axis=0), target.mean(axis=0)
    w = np.linalg.solve((x - centre).T @ (x - centre) + langid.RIDGE * len(langs) * np.eye(x.shape[1]) / 100, (x - centre).T @ (target - middle))
    margin = (np.array([kernel(grams(text, alphabet), b) for b in sets]) @ nystrom - centre) @ w + middle
    got, score = model.decide([text])
    assert got[0] == names[int(margin.argmax())]
    sharp = np.exp(4 * (margin - margin.max()))
    assert np.isclose(score[0], 1 / sharp.sum(), atol=1e-4)


def test_decisions(model):
    got, score = model.decide(["the king of the hill", "über die große straße", "король и книга", None, "", "12 - !?", " \n"])
    assert got == ["en", "de", "ru", "und", "und", "und", "und"]
    assert ((0 <= score) & (score <= 1)).all()


def test_edges(edge_docs, edge_rows, no_docs, model):
    rows = langid.predict_languages(edge_docs, model).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert langid.predict_languages(no_docs, model).count() == 0
    assert langid.train_languages(no_docs).decide(["abc"])[0] == ["und"]


def test_held_out(spark, spark_sf):
    from ledgermatch.llm.queries import op7_language_kernel

    sf = spark_sf.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_language_kernel(spark, sf).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


SCRIPTS = {
    "zh": ["我们今天去学校学习中文和历史", "他们在北京的公司里工作了很多年", "这个城市的人口比以前多了", "中国的历史很长文化也很丰富", "他今天在学校里学习历史"],
    "ja": ["私たちは今日学校で日本語を勉強します", "彼は東京の会社で長い間働いています", "この町の人口は前より多くなりました", "日本の歴史はとても長いです", "彼は今日学校で歴史を勉強しています"],
    "ko": ["우리는 오늘 학교에서 한국어를 공부합니다", "그는 서울의 회사에서 오랫동안 일했습니다", "이 도시의 인구는 전보다 많아졌습니다", "한국의 역사는 매우 깁니다", "그는 오늘 학교에서 역사를 공부합니다"],
    "ru": ["мы сегодня идём в школу учить язык", "он много лет работал в компании в москве", "население этого города стало больше", "история россии очень длинная", "он сегодня учит историю в школе"],
    "uk": ["ми сьогодні йдемо до школи вивчати мову", "він багато років працював у компанії в києві", "населення цього міста стало більшим", "історія україни дуже довга", "він сьогодні вивчає історію у школі"],
    "el": ["σήμερα πηγαίνουμε στο σχολείο για να μάθουμε", "δούλεψε πολλά χρόνια στην εταιρεία στην αθήνα", "ο πληθυσμός της πόλης έγινε μεγαλύτερος", "η ιστορία της ελλάδας είναι μεγάλη", "σήμερα μαθαίνει ιστορία στο σχολείο"],
    "ar": ["نذهب اليوم إلى المدرسة لنتعلم اللغة", "عمل سنوات كثيرة في الشركة في القاهرة", "أصبح عدد سكان هذه المدينة أكبر", "تاريخ مصر طويل جدا", "يتعلم اليوم التاريخ في المدرسة"],
    "fa": ["ما امروز برای یادگیری زبان به مدرسه می رویم", "او سالهای زیادی در شرکت در تهران کار کرد", "جمعیت این شهر بیشتر شده است", "تاریخ ایران بسیار طولانی است", "او امروز در مدرسه تاریخ یاد می گیرد"],
    "en": ["today we go to the school to learn the language", "he worked for many years in the company in london", "the number of people in this city has grown", "the history of england is very long", "today he learns history in the school"],
    "de": ["heute gehen wir in die schule und lernen die sprache", "er hat viele jahre bei der firma in berlin gearbeitet", "die zahl der menschen in dieser stadt ist größer geworden", "die geschichte von deutschland ist sehr lang", "heute lernt er geschichte in der schule"],
    "fr": ["aujourd'hui nous allons à l'école pour apprendre la langue", "il a travaillé de nombreuses années dans la société à paris", "le nombre de personnes dans cette ville a augmenté", "l'histoire de la france est très longue", "aujourd'hui il apprend l'histoire à l'école"],
    "cs": ["dnes jdeme do školy učit se jazyk", "pracoval mnoho let ve firmě v praze", "počet lidí v tomto městě je větší", "historie české země je velmi dlouhá", "dnes se učí historii ve škole"],
}


def test_many_scripts():
    """More letters than 125, the former bound; Chinese, Japanese and Korean among them."""
    assert len({c for ts in SCRIPTS.values() for t in ts for c in t}) > 200
    model = langid.fit_languages([t for ts in SCRIPTS.values() for t in ts[:4]], [g for g, ts in SCRIPTS.items() for _ in ts[:4]])
    assert model.decide([ts[4] for ts in SCRIPTS.values()])[0] == list(SCRIPTS)


def test_grams_of_rare_letters_differ(model):
    a, b = (set(model.grams.distinct(t).tolist()) for t in ("学校で勉強", "회사에서 일"))
    assert len(a & b) == 1  # the boundary
    assert len(model.grams.distinct("".join(map(chr, range(0x4E00, 0x4E00 + 5000))))) > 14_900


def test_scripts_of_rare_letters():
    """Five scripts hold 140 frequent letters; the letters of three others are rare each, and have no blanks."""
    rng = np.random.default_rng(5)
    ranges = {"la": (0x61, 26), "ac": (0xE0, 23), "ru": (0x430, 32), "el": (0x3B1, 25), "ar": (0x628, 19), "he": (0x5D0, 27)}
    rare = {"zh": [(0x4E00, 400)], "ko": [(0xAC00, 400)], "ja": [(0x4E00, 400), (0x3041, 80)]}

    def text(g):
        if g in ranges:
            return " ".join("".join(chr(ranges[g][0] + i) for i in rng.permutation(ranges[g][1])[:13]) for _ in range(8))
        spans = rare[g]
        return "".join(chr(spans[i % len(spans)][0] + rng.integers(spans[i % len(spans)][1])) for i in range(60))

    langs = [g for g in [*ranges, *rare] for _ in range(12)]
    model = langid.fit_languages([text(g) for g in langs], langs)
    asked = [g for g in [*ranges, *rare] for _ in range(10)]
    assert model.decide([text(g) for g in asked])[0] == asked


def test_training_takes_one_text_of_each_id(make_docs, monkeypatch):
    """Ids that hold most rows neither fill a language's places nor come as all pairs."""
    words = ["the house", "a garden", "that king", "other thing"]
    rows = [(1, f"{words[i % 4]} once {i}" if i % 2 else "the same text", "en") for i in range(400)]
    rows += [(3, "das haus am see", "en")] * 300 + [(3, "das haus am see", "de")] * 300
    rows += [(i, f"{words[i % 4]} by itself", "en") for i in range(1000, 1200)]
    taken = {}
    grams = langid.Grams()
    of_text = lambda t: tuple(sorted(grams.distinct(t)))
    monkeypatch.setattr(langid, "fit_presence", lambda sets, langs, marks: taken.update(sets=[tuple(s) for s in sets], langs=langs))
    langid.train_languages(make_docs(rows), max_rows=100)
    assert taken["langs"].count("en") == 100 and taken["langs"].count("de") == 1
    of_one = {of_text(t) for i, t, _ in rows if i == 1}
    assert sum(s in of_one for s in taken["sets"]) <= 1
    first = taken["sets"]
    langid.train_languages(make_docs(rows[::-1]), max_rows=100)
    assert taken["sets"] == first
    langid.train_languages(make_docs(rows), max_rows=1000)
    usable = {i for i in (1, *range(1000, 1200)) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert taken["langs"].count("en") == len(usable) + 1 and sum(s in of_one for s in taken["sets"]) == (1 in usable)


def _many_languages(n, rows, seed=5):
    """Texts of ``n`` invented languages, each with words of its own from three syllable sets in common use."""
    import random

    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèñçøåабвгдежзиклмнопрсту"
    out = []
    for lang in range(n):
        own = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 4))) for _ in range(40)]
        for _ in range(rows):
            out.append((f"l{lang:03d}", " ".join("".join(rng.choice(own) for _ in range(rng.randint(1, 3))) for _ in range(120))))
    return out


def test_many_languages_fit_in_bounded_memory():
    import tracemalloc

    rows = _many_languages(100, 16)
    train, held = [r for i, r in enumerate(rows) if i % 4], [r for i, r in enumerate(rows) if i % 4 == 0]
    grams = langid.Grams()
    sets = [grams.distinct(t) for _, t in train]
    tracemalloc.start()
    model = langid.fit_presence(sets, [g for g, _ in train], 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6, peak
    names, _ = model.decide([t for _, t in held])
    assert np.mean([a == b for a, (b, _) in zip(names, held, strict=True)]) > 0.97


def test_bounds_are_shared_by_the_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "TOTAL_ROWS", 60)
    monkeypatch.setattr(langid, "LEAST_ROWS", 2)
    monkeypatch.setattr(langid, "TOTAL_LANDMARKS", 40)
    monkeypatch.setattr(langid, "TOTAL_WEIGHTS", 20 * 3000)
    kept = []
    plain = langid.fit_presence
    monkeypatch.setattr(langid, "fit_presence", lambda sets, langs, marks: kept.append((len(sets), marks)) or plain(sets, langs, marks))
    rows = _many_languages(20, 30)
    docs = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.train_languages(docs)
    assert kept == [(60, 2)] and len(model.languages) == 20 and model.weights.shape == (3001, 20)
    found = langid.predict_languages(docs, model).select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.9


def test_a_column_named_like_the_result_is_replaced(spark, model):
    docs = spark.createDataFrame([(1, "the house and the king", "x", 5)], "doc_id long, text string, lang_pred string, score int")
    rows = langid.predict_languages(docs, model).collect()
    assert rows[0].lang_pred == "en" and 0 <= rows[0].score <= 1 and len(rows[0]) == 4
