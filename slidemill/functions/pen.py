"""Colour thresholds (red, green, blue) by which pixels of pen marks are told."""

BLUE = [
    (60, 120, 190), (120, 170, 200), (175, 210, 230), (145, 180, 210), (37, 95, 160), (30, 65, 130),
    (130, 155, 180), (40, 35, 85), (30, 20, 65), (90, 90, 140), (60, 60, 120), (110, 110, 175),
]
GREEN = [
    (150, 160, 140), (70, 110, 110), (45, 115, 100), (30, 75, 60), (195, 220, 210), (225, 230, 225), (170, 210, 200), (20, 30, 20),
    (50, 60, 40), (30, 50, 35), (65, 70, 60), (100, 110, 105), (165, 180, 180), (140, 140, 150), (185, 195, 195),
]
RED = [(150, 80, 90), (110, 20, 30), (185, 65, 105), (195, 85, 125), (220, 115, 145), (125, 40, 70), (100, 50, 65), (85, 25, 45)]
#: Channels that a pixel exceeds to pass a triple: elsewhere it has to stay below. A mode is passed if each triple is by one channel at least.
ABOVE = {"red": (False, True, True), "green": (True, False, False), "blue": (True, True, False)}
MODES = {"red": RED, "green": GREEN, "blue": BLUE}
