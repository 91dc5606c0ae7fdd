"""OCR and model providers: their answers are tables. The default replays a table; others run in Arrow batches."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..session import small_batches


class ModelProvider(ABC):
    """Answers prompts (document_id, item_key, prompt) with schemas.RESPONSES."""

    name = "model"

    def available(self) -> tuple[bool, str | None]:
        return True, None

    @abstractmethod
    def answer(self, stage: str, prompts: DataFrame) -> DataFrame: ...


class Replay(ModelProvider):
    """Answers out of a table of responses; what it lacks is an error, not an exception."""

    name = "replay"

    def __init__(self, responses: DataFrame):
        self.responses = responses

    def answer(self, stage: str, prompts: DataFrame) -> DataFrame:
        key = F.col("item_key") if "item_key" in prompts.columns else F.lit("")
        asked = prompts.select("document_id", key.alias("item_key"))
        have = self.responses.where(F.col("stage") == stage).withColumn("item_key", F.coalesce("item_key", F.lit("")))
        rows = asked.join(have.drop("stage"), ["document_id", "item_key"], "left")
        return rows.select("document_id", F.lit(stage).alias("stage"), "item_key", "response_json", F.coalesce("error", F.when(F.col("response_json").isNull(), "no response")).alias("error"))


def bisected(call: Callable[[list], list], asked: list, tries: int = 1) -> list[tuple[object, str | None]]:
    """An (answer, error) for each of the prompts: a call that fails is split in halves until the prompts at fault stand alone, which are
    asked `tries` times. With k prompts at fault among n, about 2 k log2(n) calls are made."""
    if not asked:
        return []
    for left in range(tries if len(asked) == 1 else 1, 0, -1):
        try:
            told = list(call(asked))
            if len(told) != len(asked):
                raise ValueError(f"{len(told)} answers to {len(asked)} prompts")
            return [(x, None if x is not None else "no answer") for x in told]
        except Exception as e:  # whatever a provider raises is an error of its prompts
            if len(asked) == 1 and left == 1:
                return [(None, str(e) or type(e).__name__)]
    half = len(asked) // 2
    return bisected(call, asked[:half], tries) + bisected(call, asked[half:], tries)


class Batched(ModelProvider):
    """Answers by a function on lists of prompts, in batches on the executors; a prompt that fails gets an error, and no other one of its batch.

    Where a stage has crops, the function gets (prompt, page, crop) in place of the prompt."""

    name = "batched"

    def __init__(self, call: Callable[[list[str]], list[str]], tries: int = 1):
        self.call, self.tries = call, tries

    def answer(self, stage: str, prompts: DataFrame) -> DataFrame:
        call, tries = self.call, self.tries

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = b[["document_id", "item_key"]].copy()
                out.insert(1, "stage", stage)
                asked = list(zip(b["prompt"], b["page_number"], b["crop"], strict=True)) if "crop" in b else b["prompt"].tolist()
                told = bisected(call, asked, tries)
                out["response_json"], out["error"] = [x for x, _ in told], [e for _, e in told]
                yield out

        rows = prompts if "item_key" in prompts.columns else prompts.withColumn("item_key", F.lit(""))
        return rows.select("document_id", "item_key", "prompt", *(c for c in ("page_number", "crop") if "crop" in prompts.columns)).mapInPandas(run, schemas.RESPONSES)


class OcrProvider(ABC):
    """Reads pages (schemas.PAGES) to tokens (schemas.TOKENS)."""

    name = "ocr"

    def available(self) -> tuple[bool, str | None]:
        return True, None

    @abstractmethod
    def tokens(self, pages: DataFrame) -> DataFrame: ...


class ReplayOcr(OcrProvider):
    """Tokens out of a table."""

    name = "replay"

    def __init__(self, table: DataFrame):
        self.table = table

    def tokens(self, pages: DataFrame) -> DataFrame:
        return self.table.join(pages.select("document_id", "page_number"), ["document_id", "page_number"], "left_semi")


#: An engine gets pages of so many bytes at once, or LEAST_PAGES; tokens are sent on by so many rows, however many a page has.
PAGE_BYTES, LEAST_PAGES, SEND_ROWS = 1 << 20, 8, 10_000


def portions(pages: list[tuple]) -> Iterator[list[tuple]]:
    """Pages (.., image) in turn, in lists of up to PAGE_BYTES, or of LEAST_PAGES where those are more."""
    some, held = [], 0
    for page in pages:
        if len(some) >= LEAST_PAGES and held + len(page[-1] or b"") > PAGE_BYTES:
            yield some
            some, held = [], 0
        some.append(page)
        held += len(page[-1] or b"")
    if some:
        yield some


class BatchedOcr(OcrProvider):
    """Reads pages by a function on lists of (document_id, page_number, image): it gives for each page a list of tokens, dicts with names of schemas.TOKENS.
    A page that fails gets an error and no other one of its batch. A task holds one portion of pages with its tokens, and SEND_ROWS rows to send."""

    name = "batched"

    def __init__(self, call: Callable[[list], list], tries: int = 1):
        self.call, self.tries = call, tries

    def read(self, pages: DataFrame) -> DataFrame:
        """schemas.TOKENS with an error column; a page without words gives no rows, one that can't be read a row with its error alone. Write it before it
        is used twice: each use reads the pages anew."""
        call, tries = self.call, self.tries
        names = [part.split()[0] for part in schemas.TOKENS.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for asked in portions(list(zip(b["document_id"], b["page_number"], b["image"], strict=True))):
                    out = []
                    for (document, number, _), (tokens, error) in zip(asked, bisected(call, asked, tries), strict=True):
                        if error is not None:
                            out.append(dict.fromkeys(names) | {"document_id": document, "page_number": number, "error": error})
                        for i, t in enumerate(tokens or []):
                            out.append(dict.fromkeys(names) | {k: t[k] for k in names if k in t} | {"document_id": document, "page_number": number, "token_ord": i, "error": None})
                            if len(out) >= SEND_ROWS:
                                yield frame(out)
                                out = []
                    yield frame(out)

        frame = lambda out: pd.DataFrame(out, columns=[*names, "error"]).astype({c: "Int32" for c in names if c not in ("document_id", "conf", "text")})
        small_batches(pages.sparkSession)
        return pages.select("document_id", "page_number", "image").mapInPandas(run, f"{schemas.TOKENS}, error string")

    def tokens(self, pages: DataFrame) -> DataFrame:
        return self.read(pages).where("error IS NULL").drop("error")

    def errors(self, pages: DataFrame) -> DataFrame:
        """document_id, page_number and error of pages that can't be read."""
        return self.read(pages).where("error IS NOT NULL").select("document_id", "page_number", "error")


def engine(made: dict[str, Callable[[], OcrProvider]], name: str) -> OcrProvider:
    """The provider of this name; an unknown or unavailable one is an error that says why."""
    if name not in made:
        raise ValueError(f"unknown engine {name!r}: one of {', '.join(sorted(made))}")
    own = made[name]()
    good, why = own.available()
    if not good:
        raise RuntimeError(f"engine {name!r} is not available: {why}")
    return own
