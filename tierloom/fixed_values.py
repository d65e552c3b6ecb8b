"""Values that must equal those of the data formats being read and written."""

# Blocks of the 543-point landmark layout (offset, length).
BODY = (0, 33)
LEFT_HAND = (33, 21)
RIGHT_HAND = (54, 21)
FACE = (75, 468)
N_LANDMARKS = 543

# Face-mesh points (index within the face block).
LIPS = [0, 13, 14, 17, 37, 39, 40, 61, 78, 80, 81, 82, 84, 87, 88, 91, 95, 146, 178, 181,
        185, 191, 267, 269, 270, 291, 308, 310, 311, 312, 314, 317, 318, 321, 324, 375,
        402, 405, 409, 415]
LEFT_EYE = [249, 263, 362, 373, 374, 380, 381, 382, 384, 385, 386, 387, 388, 390, 398, 466]
RIGHT_EYE = [7, 33, 133, 144, 145, 153, 154, 155, 157, 158, 159, 160, 161, 163, 173, 246]
LEFT_EYEBROW = [276, 282, 283, 285, 293, 295, 296, 300, 334, 336]
RIGHT_EYEBROW = [46, 52, 53, 55, 63, 65, 66, 70, 105, 107]
NOSE_BRIDGE = [1, 2, 4, 5, 6, 168, 197]
# Nose, shoulders, elbows and wrists of the body block.
UPPER_BODY = [0, 11, 12, 13, 14, 15, 16]


def _points(offset_length: tuple[int, int]) -> list[int]:
    return list(range(offset_length[0], sum(offset_length)))


def _face(*regions: list[int]) -> list[int]:
    return [FACE[0] + i for i in sorted(set().union(*regions))]


_SMALL_FACE = _face(LIPS, NOSE_BRIDGE)
_LARGE_FACE = _face(LIPS, NOSE_BRIDGE, LEFT_EYE, RIGHT_EYE, LEFT_EYEBROW, RIGHT_EYEBROW)
_HANDS = _points(LEFT_HAND) + _points(RIGHT_HAND)

PRESETS = {
    "compact": UPPER_BODY + _HANDS + _SMALL_FACE,
    "extended": UPPER_BODY + _HANDS + _LARGE_FACE,
    "full": _points(BODY) + _HANDS + _LARGE_FACE,
}

# Coordinates per landmark and feature mode.
MODE_WIDTH = {"raw": 3, "velocity": 9, "xy_velocity": 6, "norm_xy_velocity": 6, "xy_only": 2}

# First position and length of each hand inside a preset of this size.
HAND_BLOCKS = {96: ((7, 21), (28, 21)), 148: ((7, 21), (28, 21)), 174: ((33, 21), (54, 21))}

# Wrist points per hand as (body point, hand point).
WRISTS = {"right": (16, 54), "left": (15, 33)}

# Parent and child of each bone, as positions in the compact preset.
BODY_BONES = [(0, 1), (0, 2), (1, 3), (2, 4), (3, 5), (4, 6)]


def _finger_bones(wrist: int) -> list[tuple[int, int]]:
    """Five chains of four bones that start at the wrist of a 21-point hand."""
    bones = []
    for finger in range(5):
        joints = [0] + [finger * 4 + j for j in range(1, 5)]
        bones += [(wrist + a, wrist + b) for a, b in zip(joints, joints[1:])]
    return bones


BONES = BODY_BONES + _finger_bones(7) + _finger_bones(28)

# Tier names of annotation files.
HUMAN_GLOSS_TIERS = {"S1_Gloss_RH": "right", "S1_Gloss_LH": "left"}
AI_GLOSS_TIERS = {"AI_Gloss_RH": "right", "AI_Gloss_LH": "left"}
AI_CONFIDENCE_TIER = "AI_Confidence"
TRANSLATION_TIER = "S1_Translation"

# Annotation counts that start a new training run.
RETRAIN_STEPS = [500, 2000, 5000, 10000]
