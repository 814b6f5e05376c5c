"""Names, keys, replies and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shape of a grounding model's reply.
REPLY = "array<struct<label:string,bbox_2d:array<double>>>"


def part(text: Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's group as a number, null where there is no match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("int")


#: The shapes of names of clips, of keys of windows and of names of action logs.
SCENE, SCENE_PART = r"scene(\d+)(?:_part(\d+))?", r"scene\d+_part(\d+)"
WINDOW_KEY = r"frames_(\d+)_to_(\d+)"
ACTION_FILE = r"(.*)_person_(\d+)_actions\.json"


def clip_parts(name: Column) -> tuple[Column, Column]:
    """(scene, part) of `{video}_scene{i}[_part{j}]`."""
    return part(name, SCENE), part(name, SCENE_PART)


def window_range(key: Column) -> tuple[Column, Column]:
    return part(key, WINDOW_KEY), part(key, WINDOW_KEY, 2)


def action_file(name: Column) -> tuple[Column, Column]:
    return F.nullif(F.regexp_extract(name, ACTION_FILE, 1), F.lit("")), part(name, ACTION_FILE, 2)


def video_of(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def stem(path: Column) -> Column:
    return F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)


def natural_key(name: Column) -> Column:
    """A key whose order as text is the order of the numbers in it: runs of digits lose leading
    zeros and follow the number of digits that are left, of which a run has fewer than 10,000."""
    runs = F.split(F.regexp_replace(name, r"(\d+)", "\x01$1\x01"), "\x01")
    bare = lambda r: F.regexp_replace(r, "^0+", "")
    sized = lambda r: F.concat(F.lpad(F.length(bare(r)).cast("string"), 4, "0"), bare(r))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d+$"), sized(r)).otherwise(r)), "")


def replied_boxes(reply: Column) -> Column:
    """Items of the outermost bracketed list in a reply, up to the first without a box; labels
    trimmed and in lower case. No list or bad JSON: empty."""
    items = F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), REPLY)
    items = F.coalesce(items, F.expr(f"cast(array() as {REPLY})"))
    boxes = F.transform(items, lambda x: x["bbox_2d"])
    stop = F.array_position(F.transform(boxes, lambda b: b.isNull()), True)
    kept = F.when(stop > 0, F.slice(items, F.lit(1), (stop - 1).cast("int"))).otherwise(items)
    named = lambda x: F.lower(F.trim(F.coalesce(x["label"], F.lit("robot_part"))))
    return F.transform(kept, lambda x: F.struct(named(x).alias("label"), x["bbox_2d"].alias("bbox_2d")))


def checked_label(label: Column, known: list[str]) -> Column:
    return F.when(label.isin(known), label).otherwise(F.lit("unknown"))


def class_number(name: Column) -> Column:
    """200 person, 201 humanoid or robot, 202 any other."""
    low = F.lower(name)
    return F.when(low.contains("person"), 200).when(low.contains("humanoid") | low.contains("robot"), 201).otherwise(202)


def frame_rate(text: Column) -> Column:
    """`num/den` or a plain number; null if it is neither."""
    parts = F.split(text, "/")
    return F.try_divide(parts[0].try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double"))


def samples(n: Column, k: int) -> Column:
    """k whole indices spread evenly over 0 to n - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1)).cast("int"))


def prompts(names: Column, size: int = 12) -> Column:
    """Class names in groups of `size`, each group one prompt of names between dots."""
    starts = F.sequence(F.lit(1), F.size(names), F.lit(size))
    return F.transform(starts, lambda s: F.concat(F.array_join(F.slice(names, s, size), " . "), F.lit(" .")))


def is_tool(name: Column) -> Column:
    """Whether a label names a robot or an arm."""
    return name.contains("robot") | name.contains("arm")
