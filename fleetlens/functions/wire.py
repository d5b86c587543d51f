"""Chat requests and responses between columns and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.schemas import CHOICES, WIRE_RESPONSE

# Request defaults of the chat API.
REQUEST_DEFAULTS = {"max_tokens": 512, "temperature": 0.7, "top_p": 1.0, "n": 1, "stream": False}


def request_to_wire(
    model: Column,
    messages: Column,
    *,
    stop: Column | None = None,
    extra: Column | None = None,
    **settings: Column,
) -> Column:
    """JSON body of a chat request.

    Missing settings take their defaults, ``stop`` appears only when not empty, and the
    keys of ``extra`` (a JSON object as text) replace those of the body.
    """
    fields = [model.alias("model"), messages.alias("messages")]
    for name, default in REQUEST_DEFAULTS.items():
        given = settings.get(name)
        value = F.lit(default) if given is None else F.coalesce(given, F.lit(default))
        fields.append(value.alias(name))
    if stop is not None:
        # to_json leaves null fields out, so an empty list disappears.
        fields.append(F.when(F.size(stop) > 0, stop).alias("stop"))
    body = F.to_json(F.struct(*fields))
    if extra is None:
        return body
    own = F.parse_json(body).cast("map<string,variant>")
    added = F.try_parse_json(extra).cast("map<string,variant>")
    kept = F.map_filter(own, lambda key, _: ~F.map_contains_key(added, key))
    return F.when(added.isNull(), body).otherwise(F.to_json(F.map_concat(kept, added)))


def response_from_wire(body: Column, served_by_key: str = "_served_by") -> Column:
    """Typed response struct of a JSON response, absent fields filled in."""
    raw = F.from_json(body, WIRE_RESPONSE)
    usage = raw["usage"]

    def count(name: str) -> Column:
        return F.coalesce(usage[name], F.lit(0).cast("long")).alias(name)

    choices = F.transform(
        F.coalesce(raw["choices"], F.array().cast(CHOICES)),
        lambda c: F.struct(
            c["index"].alias("index"),
            c["message"].alias("message"),
            F.coalesce(c["finish_reason"], F.lit("stop")).alias("finish_reason"),
        ),
    )
    return F.struct(
        F.coalesce(raw["id"], F.lit("")).alias("id"),
        F.coalesce(raw["object"], F.lit("chat.completion")).alias("object"),
        F.coalesce(raw["created"], F.lit(0).cast("long")).alias("created"),
        F.coalesce(raw["model"], F.lit("")).alias("model"),
        choices.alias("choices"),
        F.struct(count("prompt_tokens"), count("completion_tokens"), count("total_tokens")).alias("usage"),
        F.get_json_object(body, f"$.{served_by_key}").alias("served_by"),
    )
