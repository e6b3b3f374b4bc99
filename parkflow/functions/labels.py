"""Class names, directions, path parts and other small vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The public COCO class names, by id.
CLASS_NAMES = (
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light",
    "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat", "dog", "horse", "sheep", "cow",
    "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella", "handbag", "tie", "suitcase", "frisbee",
    "skis", "snowboard", "sports ball", "kite", "baseball bat", "baseball glove", "skateboard", "surfboard", "tennis racket", "bottle",
    "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich", "orange",
    "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch", "potted plant", "bed",
    "dining table", "toilet", "tv", "laptop", "mouse", "remote", "keyboard", "cell phone", "microwave", "oven",
    "toaster", "sink", "refrigerator", "book", "clock", "vase", "scissors", "teddy bear", "hair drier", "toothbrush",
)
PLATE_CLASS, PLATE_LABEL = -1, "license_plate"
DEFAULT_CLASSES, DEFAULT_CONFIDENCE = (0, 1, 2, 3, 5, 7), 0.25


def merge_class(c: Column) -> Column:
    """Buses and trucks count as cars, motorcycles as bicycles."""
    return F.when(c.isin(5, 7), 2).when(c == 3, 1).otherwise(c)


def class_label(c: Column, report: bool = False) -> Column:
    """Name of a class id. report: null is `unknown`, an id without a name `unknown (id)`."""
    names = F.get(F.array(*[F.lit(n) for n in CLASS_NAMES]), F.when(c.between(0, 79), c.cast("int")).otherwise(-1))
    name = F.when(c == PLATE_CLASS, F.lit(PLATE_LABEL)).otherwise(names)
    if not report:
        return name
    return F.when(c.isNull(), F.lit("unknown")).otherwise(F.coalesce(name, F.concat(F.lit("unknown ("), c.cast("string"), F.lit(")"))))


def label_from_filename(path: Column, labels: list[str]) -> Column:
    """The one valid label among the words of a file's stem; null if there is none or more than one."""
    words = F.split(F.lower(stem(path)), "[^a-z0-9]+")
    found = F.array_intersect(words, F.array(*[F.lit(x) for x in labels]))
    return F.when(F.size(found) == 1, found[0])


def direction_words(lr: Column, fb: Column) -> tuple[Column, Column]:
    side = F.when(lr == -1, "left").when(lr == 1, "right").otherwise("unknown")
    way = F.when(fb == 1, "forward").when(fb == -1, "back").otherwise("unknown")
    return side, way


#: The spellings an option for a direction may have.
LEFT_OPTIONS, RIGHT_OPTIONS = ("left", "right-left", "going-left", "going_left", "right_left"), ("right", "left-right", "going-right", "going_right", "left_right")


def parse_direction_option(s: Column) -> Column:
    t = F.lower(F.trim(s))
    return F.when(t.isin(*LEFT_OPTIONS), "RIGHT_LEFT").when(t.isin(*RIGHT_OPTIONS), "LEFT_RIGHT").otherwise("UNKNOWN")


def direction_from_name(path: Column) -> Column:
    """From the words in a path; left wins."""
    p = F.lower(path)
    return F.when(p.contains("left"), "RIGHT_LEFT").when(p.contains("right"), "LEFT_RIGHT").otherwise("UNKNOWN")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without what follows its last dot."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(basename(path), r".(\.[^.]*)$", 1)


def parent(path: Column) -> Column:
    """Name of the folder that holds the file; empty if none is given."""
    return F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)


def relative_to(path: Column, folder: str) -> Column:
    root = folder.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 2**31 - 1)).otherwise(path)


def video_group(path: Column, source_video: Column) -> Column:
    """The manifest's video, else the folder, else a placeholder."""
    folder = parent(path)
    return F.coalesce(basename(source_video), F.when(folder != "", folder), F.lit("(unknown video)"))


def best_frame_name(video: Column, entity: Column, direction: Column, label: Column, category: str) -> Column:
    return F.concat(stem(video), F.lit("/entity_"), entity.cast("string"), F.lit("_"), direction, F.lit("_"), F.coalesce(label, F.lit(category)))


def relative_error_bucket(e: Column) -> Column:
    return F.when(e <= 0.05, "<=5%").when(e <= 0.2, "<=20%").when(e <= 0.5, "<=50%").when(e.isNotNull(), ">50%")


def miss_bucket(d: Column) -> Column:
    return F.when(d >= 4, "4+").when(d >= 1, d.cast("string"))


def resolve_classes(tokens: Column) -> Column:
    """Ids of an array of class names or ids: distinct, in order, unknown names left out; none left is an error."""
    names = F.map_from_arrays(F.array(*[F.lit(n) for n in [*CLASS_NAMES, "plate"]]), F.array(*[F.lit(i) for i in [*range(80), PLATE_CLASS]]))
    clean = lambda t: F.lower(F.trim(t))
    ids = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(names, clean(t)), F.when(clean(t).rlike("^[0-9]+$"), clean(t).try_cast("int"))))
    ids = F.array_distinct(F.filter(ids, lambda i: i.between(-1, 79)))
    return F.when(F.size(ids) > 0, ids).otherwise(F.raise_error(F.lit("no known class is left")))
