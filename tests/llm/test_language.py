from quarrylight.llm import language

SAMPLES = {
    "es": "La respuesta del seminario señala el archivo de la biblioteca. Nadie había leído el cuaderno hasta ahora.",
    "en": "The answer of the seminar points to the archive of the library. Nobody had read the notebook until now.",
    "fr": "La réponse du séminaire signale le dossier de la bibliothèque. Personne n'avait lu le cahier jusqu'ici.",
    "de": "Die Antwort des Seminars verweist auf das Archiv der Bibliothek. Niemand hatte das Heft bisher gelesen.",
    "it": "La risposta del seminario segnala l'archivio della biblioteca. Nessuno aveva letto il quaderno finora.",
    "pt": "A resposta do seminário aponta o arquivo da biblioteca. Ninguém tinha lido o caderno até agora.",
    "ca": "La resposta del seminari assenyala l'arxiu de la biblioteca. Ningú no havia llegit el quadern fins ara.",
}


def corpus():
    rows, n = [], 0
    for code, text in SAMPLES.items():
        for k in range(8):
            n += 1
            rows.append((n, text, {0: code, 1: code.upper(), 2: f"{code}-XX", 3: language.NAMES[code][1]}.get(k, code), "x"))
    return rows


CASES = [
    (101, SAMPLES["es"], "en"), (102, SAMPLES["fr"], None), (103, SAMPLES["de"] + "\n" + SAMPLES["it"], "de"), (104, SAMPLES["en"] + " «La réponse du séminaire de la bibliothèque».", "en"), (105, "{\"a\": 1}\nfor k, v in rows.items():\n    total += v", "xx"),
    (106, None, "es"), (107, "", None), (108, SAMPLES["pt"], "klingon"), (109, "# La respuesta del seminario\n\n" + SAMPLES["en"], "eng"), (110, SAMPLES["ca"] * 400, "es"),
]


def test_labels_and_mixtures(spark):
    rows = corpus() + [(i, t, lab, "x") for i, t, lab in CASES]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, label string")
    held = language.fit_filter(docs)
    found = language.languages(docs, held)
    assert {(r.doc_id, s.lang) for r in language.segments(docs, held).collect() for s in r.segments} >= {(r.doc_id, r.lang) for r in found.collect()}
    got = {(r.doc_id, r.lang) for r in language.wrong_labels(found).collect()}
    assert got == {(101, "es"), (102, "fr"), (103, "de"), (103, "it"), (108, "pt"), (110, "ca")}
    assert all(0 < r.confidence <= 1 for r in found.collect())


def test_filter_counts_all_languages():
    import numpy as np

    held = language.LanguageFilter(cells=1 << 12)
    values = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    held.add(values[:100], np.full(100, 1, np.uint8))
    held.add(values[:50], np.full(50, 4, np.uint8))
    masks = held.masks(values)
    assert (masks[:50] & 5 == 5).all() and (masks[:100] & 1 == 1).all()
    assert abs((masks[100:] & 1).mean() - held.false_rates()[0]) < 0.1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    held = language.fit_filter(docs)
    assert language.languages(docs, held).count() == 0 and language.segments(docs, held).count() == 0
