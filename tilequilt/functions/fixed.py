"""Dictionaries, presets, limits and transitions that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Palette for classes without a colour of their own.
PALETTE = (
    "#22c55e", "#3b82f6", "#f97316", "#a855f7", "#ef4444",
    "#14b8a6", "#eab308", "#ec4899", "#06b6d4", "#84cc16",
    "#f43f5e", "#6366f1", "#f59e0b", "#10b981", "#8b5cf6",
)

# Model -> label, class names, own colours.
MODELS = {
    "mock": ("MockAI remote sensing", ("Vegetation", "Water", "Building", "Road"), ("#22c55e", "#0284c7", "#f97316", "#6b7280")),
    "onnx": (
        "YOLOv8n-seg COCO",
        (
            "Person", "Bicycle", "Car", "Motorcycle", "Airplane", "Bus", "Train", "Truck", "Boat", "Traffic Light",
            "Fire Hydrant", "Stop Sign", "Parking Meter", "Bench", "Bird", "Cat", "Dog", "Horse", "Sheep", "Cow",
            "Elephant", "Bear", "Zebra", "Giraffe", "Backpack", "Umbrella", "Handbag", "Tie", "Suitcase", "Frisbee",
            "Skis", "Snowboard", "Sports Ball", "Kite", "Baseball Bat", "Baseball Glove", "Skateboard", "Surfboard", "Tennis Racket", "Bottle",
            "Wine Glass", "Cup", "Fork", "Knife", "Spoon", "Bowl", "Banana", "Apple", "Sandwich", "Orange",
            "Broccoli", "Carrot", "Hot Dog", "Pizza", "Donut", "Cake", "Chair", "Couch", "Potted Plant", "Bed",
            "Dining Table", "Toilet", "TV", "Laptop", "Mouse", "Remote", "Keyboard", "Cell Phone", "Microwave", "Oven",
            "Toaster", "Sink", "Refrigerator", "Book", "Clock", "Vase", "Scissors", "Teddy Bear", "Hair Drier", "Toothbrush",
        ),
        (),
    ),
    "dota_obb": (
        "DOTA aerial OBB",
        (
            "Plane", "Baseball Diamond", "Bridge", "Ground Track Field", "Small Vehicle", "Large Vehicle", "Ship", "Tennis Court",
            "Basketball Court", "Storage Tank", "Soccer Ball Field", "Roundabout", "Harbor", "Swimming Pool", "Helicopter",
        ),
        (),
    ),
    "segformer_loveda": (
        "SegFormer LoveDA",
        ("Ignore", "Background", "Building", "Road", "Water", "Barren", "Forest", "Agricultural"),
        ("#9ca3af", "#e5e7eb", "#f97316", "#6b7280", "#0284c7", "#a16207", "#15803d", "#84cc16"),
    ),
}

# Presets of the models (path below the model folder, confidence threshold).
PRESETS = {"mock": ("", 0.3), "onnx": ("yolov8n-seg.onnx", 0.05), "dota_obb": ("yolo11n-obb.onnx", 0.05), "segformer_loveda": ("segformer-loveda-b2.onnx", 0.45)}

# Session states in order, and which may follow which.
STATES = ("IDLE", "LOADING", "TILING", "PROCESSING", "STITCHING", "SAVING", "DONE", "ERROR", "RECOVERING")
TRANSITIONS = (
    ("IDLE", "LOADING"), ("LOADING", "TILING"), ("LOADING", "ERROR"), ("TILING", "PROCESSING"), ("TILING", "ERROR"),
    ("PROCESSING", "STITCHING"), ("PROCESSING", "ERROR"), ("STITCHING", "SAVING"), ("STITCHING", "ERROR"), ("SAVING", "DONE"),
    ("SAVING", "ERROR"), ("ERROR", "RECOVERING"), ("RECOVERING", "IDLE"), ("DONE", "IDLE"),
)
TERMINAL = ("DONE", "ERROR")
WORKING = ("TILING", "PROCESSING", "STITCHING")

# Suppression thresholds of a whole session and of one tile; default configuration.
SESSION_IOU, TILE_IOU = 0.5, 0.45
CONFIG = {"tile_size": 512, "overlap": 64, "model": "mock", "model_path": "", "max_workers": 0, "conf_thresh": 0.5}

# Land-cover segmentation: side of a voting block, votes needed, detections a tile, classes left out.
BLOCK, VOTES, TILE_LIMIT, EXCLUDED = 4, 2, 256, (0, 1)
IMAGENET_MEAN, IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def class_rows() -> list[tuple[str, int, str, str]]:
    """(model, class_id, name, colour): own colours, else the palette in turn."""
    return [(m, i, n, colours[i] if i < len(colours) else PALETTE[i % len(PALETTE)]) for m, (_, names, colours) in MODELS.items() for i, n in enumerate(names)]


def class_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(class_rows(), "model string, class_id int, name string, color string")


def transition_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "from_state string, to_state string")


def state_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(STATES)), "ordinal int, state string")
