"""Fixed schemas, keys and classes."""

# The class order.
CLASSES = ("person", "head", "helmet", "vest")
PERSON, HEAD, HELMET, VEST = range(4)

DETECTIONS = "run string, camera_id long, frame long, ts timestamp, det_id long, cls int, x1 double, y1 double, x2 double, y2 double, conf double"
TILED = f"{DETECTIONS}, tile_x double, tile_y double"
REVIEWS = "review_id long, event_id string, decision string, reviewer string, decided_at timestamp"
# The decisions of a reviewer.
DECISIONS = ("CONFIRMED_VIOLATION", "FALSE_ALARM", "NEEDS_REVIEW")

FRAME = ["run", "camera_id", "frame"]
TRACK = ["run", "camera_id", "track_id"]
