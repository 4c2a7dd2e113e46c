"""Model calls as batch UDFs behind a registry, with errors kept in the row.

Models load once per Python worker and take whole batches. No weights are part of this repository: `stub` models give
fixed answers, so that plans can be built and tested; others are added with register().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MODELS: dict[tuple[str, str], Callable[[], Callable]] = {}


def register(kind: str, name: str, load: Callable[[], Callable]) -> None:
    """kind: detect, ocr or translate. load() runs once a worker and gives a function of a list of inputs."""
    _MODELS[kind, name] = load


def model(kind: str, name: str) -> Callable[[], Callable]:
    if (kind, name) not in _MODELS:
        raise ValueError(f"unknown {kind} model: {name}")
    return _MODELS[kind, name]


def _stub_detect():
    return lambda texts: [[(10 * i, 5 * i, 10 * i + 40 + len(t) % 7, 5 * i + 30) for i in range(len(t) % 4)] for t in texts]


register("detect", "stub", _stub_detect)
register("ocr", "stub", lambda: lambda texts: [t + "." for t in texts])
register("translate", "stub", lambda: lambda pairs: [f"[{lang}] {t[::-1]}" for t, lang in pairs])


def _isolated(run, values: list, fallback):
    """The batch's answers; if the batch fails, each input alone, and the fallback for those that fail."""
    try:
        return [(x, None) for x in run(values)]
    except Exception:
        out = []
        for v in values:
            try:
                out.append((run([v])[0], None))
            except Exception as e:
                out.append((fallback, str(e)))
        return out


def first_provider(*loads: Callable[[], Callable]) -> Callable[[], Callable]:
    """A load() that takes the first provider that loads; the last one's error if none does."""

    def load():
        for one in loads[:-1]:
            try:
                return one()
            except Exception:
                continue
        return loads[-1]()

    return load


def one_by_one(load: Callable[[], Callable]) -> Callable[[], Callable]:
    """A model that takes its inputs one after another, in order."""

    def opened():
        m = load()
        return lambda values: [m([v])[0] for v in values]

    return opened


def detect(image: Column, name: str = "stub") -> Column:
    """An array of boxes for each image; an image that fails has none."""
    load = model("detect", name)

    @F.pandas_udf("array<struct<min_x: int, min_y: int, max_x: int, max_y: int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = load()
        for s in batches:
            yield pd.Series([[dict(zip(("min_x", "min_y", "max_x", "max_y"), b)) for b in boxes] for boxes, _ in _isolated(m, ["" if x is None else x for x in s], [])])

    return run.asNondeterministic()(image)


def ocr(crop: Column, name: str = "stub") -> Column:
    """{value, error}: the text of each crop; '' and the error for those that fail."""
    load = model("ocr", name)

    @F.pandas_udf("value string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = load()
        for s in batches:
            yield pd.DataFrame(_isolated(m, ["" if x is None else x for x in s], ""), columns=["value", "error"])

    return run.asNondeterministic()(crop)


def translate(text: Column, lang: Column, name: str = "stub") -> Column:
    """The translation; '' for those that fail. Blank texts are left to the caller (see translate_distinct)."""
    load = model("translate", name)

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = load()
        for a, b in batches:
            yield pd.Series([x for x, _ in _isolated(m, list(zip(a.fillna(""), b.fillna(""))), "")], dtype=object)

    return run.asNondeterministic()(text, lang)


def read_and_translate(crop: Column, lang: Column, reader: str = "stub", translator: str = "stub", size: int = 64) -> Column:
    """{value, translated, error}: texts are translated while the next crops are read, in groups of `size` a worker.

    Blank texts are not translated (they give ''); crops that can't be read have '' and the error, translations that fail ''.
    """
    load_reader, load_translator = model("ocr", reader), model("translate", translator)

    @F.pandas_udf("value string, translated string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        read, say = load_reader(), load_translator()

        def turned(texts, langs):
            asked = [i for i, t in enumerate(texts) if t.strip()]
            said = dict(zip(asked, (x for x, _ in _isolated(say, [(texts[i], langs[i]) for i in asked], ""))))
            return [said.get(i, "") for i in range(len(texts))]

        with ThreadPoolExecutor(1) as pool:
            for crops, langs in batches:
                crops, langs = crops.fillna("").tolist(), langs.fillna("").tolist()
                rows, running = [], []
                for i in range(0, len(crops), size):
                    part = _isolated(read, crops[i : i + size], "")
                    rows += part
                    running.append(pool.submit(turned, [t for t, _ in part], langs[i : i + size]))
                yield pd.DataFrame({"value": [t for t, _ in rows], "translated": [x for r in running for x in r.result()], "error": [e for _, e in rows]}, dtype=object)

    return run.asNondeterministic()(crop, lang)


def translate_distinct(rows: DataFrame, text: str, lang: str, name: str = "stub") -> DataFrame:
    """Adds `translated`; each distinct text and language goes to the model once, blank texts never (they give '')."""
    filled = F.regexp_replace(F.col(text), "(?U)^\\s+|\\s+$", "") != ""
    asked = rows.where(filled).select(text, lang).distinct()
    answers = asked.withColumn("translated", translate(F.col(text), F.col(lang), name))
    return rows.join(answers, [text, lang], "left").withColumn("translated", F.coalesce("translated", F.lit("")))


def strict_upper() -> Callable:
    """A model that fails for texts with a digit, to show how errors stay in their rows."""

    def run(texts):
        if any(any(c.isdigit() for c in t) for t in texts):
            raise ValueError("digit")
        return [t.upper() for t in texts]

    return run


register("ocr", "strict", strict_upper)


def _no_device():
    raise RuntimeError("no such device")


register("ocr", "fallback", first_provider(_no_device, model("ocr", "stub")))
register("ocr", "ordered", one_by_one(model("ocr", "stub")))
