"""An outside reviewer's answers: requests as a table, calls on the executors, and a ledger that keeps each answer."""

from __future__ import annotations

import asyncio
import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources.files import opened

SYSTEM = "You review videos. Follow the rubric that you are given to the letter and answer with one JSON object."
INSTRUCTION = "Return one JSON object in the form that the prompt asks for, and nothing else."
ANSWER = "request_id string, status string, content string, error string, attempts int"


class ReviewError(RuntimeError):
    pass


class Refused(ReviewError):
    """An answer that asking again won't change."""


@dataclass(frozen=True)
class Calls:
    """How requests are made: at once in each task, tries of each, seconds before the second try (doubled each time), rows of a ledger file."""

    at_once: int = 4
    tries: int = 4
    wait: float = 1.0
    chunk: int = 50


@dataclass(frozen=True)
class Endpoint:
    """A chat-completions service in JSON mode. Called with a request's JSON text; gives the answer's text.

    Status 429 and 5xx, broken connections and timeouts can be tried again; other failures are ``Refused``.
    """

    url: str
    key: str
    timeout: float = 60.0

    def __call__(self, request: str) -> str:
        if not self.url or not self.key:
            raise Refused("the reviewer needs a url and a key")
        headers = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        try:
            with urlopen(Request(self.url, data=request.encode(), headers=headers, method="POST"), timeout=self.timeout) as response:
                body = json.loads(response.read().decode())
        except HTTPError as e:
            said = f"HTTP {e.code}: {e.read().decode(errors='replace')[-500:]}"
            raise (ReviewError if e.code == 429 or e.code >= 500 else Refused)(said) from e
        except (URLError, TimeoutError, ConnectionError, ValueError) as e:
            raise ReviewError(f"no answer: {e}") from e
        try:
            content = body["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise Refused("the answer has no choices[0].message.content") from e
        if not isinstance(content, str) or not content.strip():
            raise Refused("the answer is empty")
        return content.strip()


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """(prompt_ref, prompt) of the files below a folder; a file's name there is its ref."""
    path = folder.rstrip("/")
    read = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("at"), F.col("value").alias("prompt"))
    return read.select(F.regexp_replace(F.substring_index(F.url_decode("at"), path + "/", -1), r"^part-[0-9]+-[0-9a-f]{32}/", "").alias("prompt_ref"), "prompt")


def requests(referrals: DataFrame, signals: DataFrame, candidates: DataFrame, prompt_files: DataFrame, model: str, images: DataFrame | None = None) -> DataFrame:
    """(video_id, profile_id, prompt_ref, request_id, request) for each referral (video_id, profile_id, prompt_ref, max_windows).

    The request is a chat completion in JSON mode: the prompt, then the video's signals and its best ``max_windows``
    candidates by score, then start; ``images`` (video_id, urls) adds pictures. Its id is the hash of its text, so
    equal requests are one. A prompt that no file has, or a video without signals, is an error.
    """
    r = referrals.join(prompt_files, "prompt_ref", "left")
    r = r.withColumn("prompt", F.when(F.col("prompt").isNull(), F.raise_error(F.concat(F.lit("no prompt: "), F.coalesce("prompt_ref", F.lit("null")))).cast("string")).otherwise(F.col("prompt")))
    order = Window.partitionBy("video_id").orderBy(F.desc("score"), "start_seconds")
    most = referrals.groupBy("video_id").agg(F.max("max_windows").alias("_most"))
    ranked = candidates.drop("rank").withColumn("_k", F.row_number().over(order)).join(most, "video_id").where("_k <= _most")
    best = ranked.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("_k", F.struct(*[c for c in candidates.columns if c not in ("video_id", "rank")]).alias("c"))), lambda x, y: x["_k"] - y["_k"]).alias("_best"))
    values = F.struct(*[c for c in signals.columns if c != "video_id"])
    r = r.join(signals.select("video_id", values.alias("_signals")), "video_id", "left").join(best, "video_id", "left")
    seen = F.transform(F.slice(F.coalesce("_best", F.array().cast(best.schema["_best"].dataType)), F.lit(1), F.col("max_windows")), lambda x: x["c"])
    signals_ = F.when(F.col("_signals").isNull(), F.raise_error(F.lit("a referral of a video without signals")).cast(r.schema["_signals"].dataType)).otherwise(F.col("_signals"))
    text = F.concat(F.col("prompt"), F.lit("\n\nINPUT:\n"), F.to_json(F.struct(signals_.alias("signals"), seen.alias("candidates"), F.lit(INSTRUCTION).alias("instruction")), {"ignoreNullFields": "false"}))
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.alias("text"), F.when(url.isNotNull(), F.struct(url.alias("url"))).alias("image_url"))
    none = F.lit(None).cast("string")
    content = F.array(part("text", text, none))
    if images is not None:
        r = r.join(images.select("video_id", "urls"), "video_id", "left")
        content = F.concat(content, F.transform(F.coalesce("urls", F.array().cast("array<string>")), lambda u: part("image_url", none, u)))
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    head = F.to_json(F.struct(F.lit(model).alias("model"), F.lit(0).alias("temperature"), F.struct(F.lit("json_object").alias("type")).alias("response_format")))
    # two messages whose content differs in type, which no array of structs can hold
    whole = F.concat(F.expr("substring({0}, 1, length({0}) - 1)".format("_head")), F.lit(',"messages":['), F.to_json(say("system", F.lit(SYSTEM))), F.lit(","), F.to_json(say("user", content)), F.lit("]}"))
    r = r.withColumn("_head", head)
    return r.select("video_id", "profile_id", "prompt_ref", F.sha2(whole, 256).alias("request_id"), whole.alias("request"))


async def _called(client: Callable[[str], str], rows: list[tuple[str, str]], how: Calls) -> list[dict]:
    gate = asyncio.Semaphore(how.at_once)

    async def one(request_id: str, request: str) -> dict:
        error = ""
        async with gate:
            for k in range(1, how.tries + 1):
                try:
                    return {"request_id": request_id, "status": "answered", "content": await asyncio.to_thread(client, request), "error": None, "attempts": k}
                except Refused as e:
                    return {"request_id": request_id, "status": "refused", "content": None, "error": str(e), "attempts": k}
                except ReviewError as e:
                    error = str(e)
                    if k < how.tries:
                        await asyncio.sleep(how.wait * 2 ** (k - 1))
        return {"request_id": request_id, "status": "failed", "content": None, "error": error, "attempts": how.tries}

    return await asyncio.gather(*(one(*r) for r in rows))


def answered(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows (ANSWER), the last of each request; none if there is no ledger yet."""
    store, path = opened(ledger)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return spark.createDataFrame([], ANSWER)
    rows = spark.read.schema(f"{ANSWER}, at double").json(ledger)
    last = F.max_by(F.struct("status", "content", "error", "attempts"), F.struct((F.col("status") == "answered"), "at"))
    return rows.groupBy("request_id").agg(last.alias("x")).select("request_id", "x.*")


def ask(asked: DataFrame, client: Callable[[str], str], ledger: str, how: Calls = Calls()) -> DataFrame:
    """The requests with status, content, error and attempts; what the ledger (a shared folder) has answered isn't asked again.

    Requests of equal text are asked once. Each task keeps ``at_once`` calls running and writes the answers of every
    ``chunk`` requests to a file whose name tells which: a task that is run again after its executor was lost finds the
    files of its chunks and asks only the rest. A client raises ``ReviewError`` for what may be tried again, up to
    ``tries`` times, and ``Refused`` for what may not; both end as rows, and only unanswered requests are asked by the
    next run. Any other error of the client stops the job; what was answered stays in the ledger.
    """
    spark = asked.sparkSession
    known = answered(spark, ledger).where("status = 'answered'").select("request_id")
    new = asked.select("request_id", "request").dropDuplicates(["request_id"]).join(known, "request_id", "left_anti")
    new = new.repartition("request_id").sortWithinPartitions("request_id")
    store, path = opened(ledger)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(ledger)
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for at in range(0, len(rows), how.chunk):
                some = rows[at : at + how.chunk]
                file = f"{path}/{hashlib.sha256(''.join(i for i, _ in some).encode()).hexdigest()}.json"
                kept = [x for x in _written(store, file) if x["status"] == "answered"]
                had = {x["request_id"] for x in kept}
                if left := [r for r in some if r[0] not in had]:
                    found = asyncio.run(_called(client, left, how))
                    _publish(store, file, kept + [x | {"at": time.time()} for x in found])
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(left)], pa.int64())})

    new.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return asked.join(answered(spark, ledger), "request_id", "left")


def _written(store: fs.FileSystem, file: str) -> list[dict]:
    if store.get_file_info(file).type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(file) as f:
        return [json.loads(x) for x in f.read().decode().splitlines()]


def _publish(store: fs.FileSystem, file: str, rows: list[dict]) -> None:
    """Whole files only: written beside, under a name that readers don't look at, then moved."""
    folder, _, name = file.rpartition("/")
    beside = f"{folder}/_{name}-{time.time_ns()}"
    with store.open_output_stream(beside) as f:
        f.write("".join(json.dumps(x) + "\n" for x in rows).encode())
    store.move(beside, file)


def results(answers: DataFrame) -> DataFrame:
    """Adds ``result``: the answer's JSON object as a map, the verdict "uncertain" where it isn't one, null where there is no answer."""
    return answers.withColumn("result", F.when(F.col("content").isNotNull(), scalars.parse_answer(F.col("content"))))
