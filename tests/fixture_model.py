"""The 45-row fixture: three names, values 1 to 15, arriving in blocks of three values per name."""

START = 1_583_899_260_000
SECONDS = (0, 5, 15, 20, 25, 35, 40, 45, 55, 60, 65, 75, 80, 85, 95)
ROWS = [(START + SECONDS[v] * 1000, name, v + 1) for block in range(0, 15, 3) for name in ("A-key-0", "B-key-0", "C-key-0") for v in range(block, block + 3)]

# window start in seconds after START: sum, max, min, count
GOLDEN = {-40: (6, 3, 1, 3), -20: (21, 6, 1, 6), 0: (45, 9, 1, 9), 20: (72, 12, 4, 9), 40: (99, 15, 7, 9), 60: (75, 15, 10, 6), 80: (42, 15, 13, 3)}
GOLDEN_LATE = {-40: (6, 3, 1, 3), -20: (17, 6, 1, 5), 0: (26, 9, 1, 6), 20: (53, 12, 5, 6), 40: (84, 15, 9, 7), 60: (75, 15, 10, 6), 80: (42, 15, 13, 3)}
