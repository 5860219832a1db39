"""Plain helpers of the tests, apart from the fixtures, so that no other conftest can hide them."""


def frames_of(spark, episodes, dataset="d", fps=10.0):
    """Frames from ``{episode: [(action, state), …]}``."""
    rows = []
    index = 0
    for episode, cells in episodes.items():
        for i, cell in enumerate(cells):
            action, state = cell if isinstance(cell, tuple) else (cell, [0.0])
            rows.append((dataset, episode, i, i, index, i / fps, 0, action, state))
            index += 1
    return spark.createDataFrame(
        rows,
        "dataset string, episode_index long, position long, frame_index long, index long, timestamp double, "
        "task_index long, action array<double>, `observation.state` array<double>",
    )


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
