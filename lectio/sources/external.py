"""Interfaces to media tools, models and services (X-01 to X-10): the relational part here, the call plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.operators.joins import resume
from lectio.sources.shared import written_once

#: Conditions after which asking again is no use, with the forms in which client libraries report them.
TERMINAL = {
    "OUT OF CREDIT": ("Error code: 402", "Insufficient credits", "insufficient_quota"),
    "AUTHENTICATION REJECTED": ("Error code: 401", "invalid_api_key", "Error code: 403"),
    "QUOTA EXHAUSTED": ("Error code: 429", "RESOURCE_EXHAUSTED", "exceeded your current quota"),
}


def ask_all(requests: DataFrame, ask: Callable[[list[str]], list[str]], key: str = "item_id", prompt: str = "prompt") -> DataFrame:
    """X-05: one row per request: (key, reply, error). ``ask`` gets a batch; a failure marks its requests."""
    kind = dict(requests.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                replies, error = ask(list(frame[prompt])), None
                if len(replies) != len(frame):
                    raise ValueError(f"{len(replies)} replies to {len(frame)} requests")
            except Exception as failure:  # noqa: BLE001  a failed call is a row, not the end of the run
                replies, error = [None] * len(frame), str(failure)[:500]
            yield pd.DataFrame({key: frame[key], "reply": replies, "error": error})

    return requests.select(key, prompt).mapInPandas(run, f"{key} {kind}, reply string, error string")


def run_judge(items: DataFrame, answered: DataFrame, ask, read: Callable[[F.Column], F.Column]) -> DataFrame:
    """X-06, A-30: ask what isn't answered yet; ``answer`` is null where the reply can't be read."""
    asked = ask_all(resume(items, answered, "item_id"), ask)
    return asked.withColumn("answer", read(F.col("reply")))


def run_summary(answers: DataFrame) -> DataFrame:
    """A-30."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return answers.agg(F.count("*").alias("asked"), F.count_if(~failed & F.col("answer").isNotNull()).alias("answered"), F.count_if(~failed & F.col("answer").isNull()).alias("unread"), F.count_if(failed).alias("failed"))


def terminal_condition(error) -> F.Column:
    """V-11: the name of the condition that an error reports, in the order of TERMINAL; null where asking again may help."""
    c = F.coalesce(F.col(error) if isinstance(error, str) else error, F.lit(""))
    return F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(c, m)), F.lit(name)) for name, markers in TERMINAL.items()])


def _is_terminal(message: str) -> bool:
    return any(marker in message for markers in TERMINAL.values() for marker in markers)


def shift_chunks(words: DataFrame, chunk: str = "chunk", seconds: float = 600.0) -> DataFrame:
    """X-02: starts of words within a chunk to starts within the recording."""
    return words.withColumn("start", F.col("start") + F.col(chunk) * seconds)


def scene_times(log) -> F.Column:
    """V-13: seconds after each ``pts_time:`` of a tool's log."""
    c = F.col(log) if isinstance(log, str) else log
    return F.transform(F.regexp_extract_all(c, F.lit(r"pts_time:(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def render(template, values: dict[str, F.Column]) -> F.Column:
    """X-10, V-14: each ``{name}`` of a template replaced."""
    out = F.col(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


# ---------------------------------------------------------------- media tools, plugged in


def probe_media(paths: DataFrame, run: Callable[[str], dict], path: str = "path") -> DataFrame:
    """X-01: (path, duration, audio, error) per file; ``run`` calls the tool on an executor and gives {duration, audio}."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for one in frame[path]:
                try:
                    found = run(one)
                    rows.append((one, float(found["duration"]), bool(found["audio"]), None))
                except Exception as failure:  # noqa: BLE001  an unreadable file is a row, not the end of the run
                    rows.append((one, None, None, str(failure)[:500]))
            yield pd.DataFrame(rows, columns=["path", "duration", "audio", "error"])

    return paths.select(path).mapInPandas(each, "path string, duration double, audio boolean, error string")


def cut_times(durations: DataFrame, lecture: str, seconds: float = 600.0) -> DataFrame:
    """X-01, X-02: (lecture, chunk, start, end) of the pieces that a recording is cut into."""
    chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("duration") / seconds) - 1, F.lit(0)).cast("int"))
    rows = durations.where("duration > 0").select(lecture, "duration", F.explode(chunks).alias("chunk"))
    return rows.select(lecture, "chunk", (F.col("chunk") * seconds).alias("start"), F.least("duration", (F.col("chunk") + 1) * seconds).alias("end"))


def slide_text(readings: DataFrame, lecture: str, time: str = "time", least: float = 0.0) -> DataFrame:
    """X-04: per frame the text of a reader's boxes (text, confidence, place) in order, and their mean confidence."""
    boxes = readings.where(F.col("confidence") >= least).groupBy(lecture, time).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda b: b["text"]), " ").alias("text"), F.avg("confidence").alias("confidence"))
    return readings.select(lecture, time).distinct().join(boxes, [lecture, time], "left").withColumn("text", F.coalesce("text", F.lit("")))


def speech_by(audio: DataFrame, detect: Callable[[str], list[tuple[float, float]]], lecture: str, path: str = "path") -> DataFrame:
    """X-03: (lecture, start, end) of speech, as a plugged voice detector finds it in each file."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(key, float(a), float(b)) for key, one in zip(frame[lecture], frame[path], strict=True) for a, b in detect(one)]
            yield pd.DataFrame(rows, columns=[lecture, "start", "end"])

    return audio.select(lecture, path).mapInPandas(each, f"{lecture} {dict(audio.dtypes)[lecture]}, start double, end double")


# ---------------------------------------------------------------- models, plugged in


def chat_request(model: str, system: str, prompt: str, temperature: float = 0.0, images: tuple[str, ...] = ()) -> dict:
    """X-05: the body of a chat call in the common form of messages with parts."""
    parts = [{"type": "image_url", "image_url": {"url": u}} for u in images] + [{"type": "text", "text": prompt}]
    return {"model": model, "temperature": temperature, "messages": [{"role": "system", "content": system}, {"role": "user", "content": parts}]}


def native_request(model: str, system: str, prompt: str, temperature: float = 0.0, images: tuple[str, ...] = ()) -> dict:
    """X-05: the body of a call in the form of contents and a system instruction."""
    parts = [{"file_data": {"file_uri": u}} for u in images] + [{"text": prompt}]
    return {"model": model, "system_instruction": {"parts": [{"text": system}]}, "contents": [{"role": "user", "parts": parts}], "generation_config": {"temperature": temperature}}


def asker(post: Callable[[dict], str], build=chat_request, tries: int = 3, **settings) -> Callable[[list[str]], list[str]]:
    """X-05: an ``ask`` for :func:`ask_all` over a transport; conditions of TERMINAL are not tried again."""

    def ask(prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            for left in reversed(range(tries)):
                try:
                    out.append(post(build(prompt=prompt, **settings)))
                    break
                except Exception as failure:
                    if not left or _is_terminal(str(failure)):
                        raise
        return out

    return ask


def decode(rows: DataFrame, generate: Callable[[list[str], float], list[str]], temperatures: tuple[float, ...], read: Callable[[F.Column], F.Column], key: str = "item_id", prompt: str = "prompt") -> DataFrame:
    """X-08: attempts in order (greedy, then sampled) until a reply can be read: (key, attempt, reply, answer).

    Each attempt's replies are written before they are read, so that no lost executor asks a model again.
    """
    done, todo = None, rows.select(key, prompt)
    for attempt, temperature in enumerate(temperatures):
        asked = ask_all(todo, lambda prompts, t=temperature: generate(prompts, t), key, prompt).withColumn("attempt", F.lit(attempt))
        asked = written_once(asked, "attempt").withColumn("answer", read(F.col("reply")))
        last = attempt == len(temperatures) - 1
        kept = asked if last else asked.where("answer IS NOT NULL")
        done = kept if done is None else done.unionByName(kept)
        todo = todo.join(asked.where("answer IS NULL").select(key), key, "left_semi")
    return done.select(key, "attempt", "reply", "answer")


def training_table(rows: DataFrame, method: str) -> DataFrame:
    """X-09: what a trainer reads: conversations for sft, (prompt, chosen, rejected) for dpo; the training itself is plugged in."""
    columns = {"sft": ["messages"], "dpo": ["prompt", "chosen", "rejected"]}
    if method not in columns:
        raise ValueError(f"no training method called {method}; known: {sorted(columns)}")
    return rows.select(*columns[method]).dropna()


def markdown(table: DataFrame, digits: int = 3, rows: int = 1000) -> str:
    """V-20: a report's table as Markdown; reports are summaries, a larger table is refused."""
    found = table.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"a report has at most {rows} rows")
    shown = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = [table.columns, ["-"] * len(table.columns), *([shown(v) for v in r] for r in found)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def steps_to_run(steps: dict[str, str], exists: Callable[[str], bool]) -> list[str]:
    """V-19: the steps, in order, whose output isn't there yet."""
    return [name for name, output in steps.items() if not exists(output)]


def check_directives(asked, declared) -> list[str]:
    """V-12: the focus directives asked for, which must be declared ones."""
    unknown = [d for d in asked if d not in declared]
    if unknown:
        raise ValueError(f"directives that are not declared: {unknown}")
    return list(asked)


def write_lecture(moments: DataFrame, lecture: str, order: str, ask: Callable[[dict, list[str]], dict], schema: str, cap: int = 40) -> DataFrame:
    """V-09: a lecture's moments in order, each asked with what was described before it; one task per lecture, whose memory is the last ``cap`` texts.

    ``ask`` gets a moment's fields and those texts and gives a row of ``schema``, with ad_text.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        said: list[str] = []
        out = []
        for row in frame.sort_values(order).to_dict("records"):
            answer = ask(row, said)
            out.append(answer)
            said = [*said, answer["ad_text"]][-cap:] if answer.get("ad_text") else said
        return pd.DataFrame(out)

    return moments.groupBy(lecture).applyInPandas(fold, schema)


def spend(calls: DataFrame, prices: DataFrame, shapes: DataFrame) -> DataFrame:
    """A-27 to A-29, X-05: dollars per stage and model: calls times tokens times price; the measured shape where there is one."""
    shape = lambda c: F.coalesce(F.col(f"measured_{c}"), F.col(f"assumed_{c}"))
    joined = calls.join(prices, "model").join(shapes, ["stage", "model"], "left")
    per_call = (shape("input") * F.col("input_price") + shape("output") * F.col("output_price")) / 1e6
    rows = joined.withColumn("per_call", per_call).withColumn("dollars", F.col("calls") * F.col("per_call")).withColumn("measured", F.col("measured_input").isNotNull())
    return rows.groupBy("stage").agg(F.sum("calls").alias("calls"), F.sum("dollars").alias("dollars"), F.bool_and("measured").alias("all_measured"))


class Approval:
    """D-29, V-21: a token that only :func:`require_approval` gives, after the price was shown."""

    _own = object()

    def __init__(self, token=None):
        if token is not Approval._own:
            raise PermissionError("spending is approved through require_approval")


def require_approval(dollars: float, approved: bool) -> Approval:
    if dollars > 0 and not approved:
        raise PermissionError(f"this would cost ${dollars:.2f}; approve it first")
    return Approval(Approval._own)
