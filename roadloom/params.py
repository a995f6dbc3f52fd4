"""Every constant of the operators, in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """compat: "documented" (UTM coordinates, drive-wide duplicate check, longer duplicate wins, flush at the
    end, circular azimuths) or "as_written" (duplicates checked within a frame only, first feature kept, no
    flush, plain azimuth difference)."""

    compat: str = "documented"
    frames_per_point: int = 60
    frames_per_video: int = 63_600
    frame_step: int = 5
    stationary_speed: float = 2.0
    screen_width: int = 1920
    screen_height: int = 1080
    overlap_percent: float = 40.0
    box_confidence: float = 0.50
    coarse_confidence: float = 0.70
    fine_confidence: float = 0.60
    lane_confidence: float = 0.65
    same_class_bonus: float = 50.0
    other_class_penalty: float = 50.0
    most_pixels: float = 800.0
    invalid: float = 9999.99
    most_drop: int = 10
    match_gap: int = 7
    vector_slack: float = 30.0
    remove_gap: int = 5
    finish_gap: int = 5
    least_observations: int = 4
    known_radius_m: float = 8.0
    dedup_radius_m: float = 20.0
    dedup_azimuth: float = 30.0
    cell_m: float = 20.0
    snap_radius_m: float = 30.0
    line_m: float = 5.0
    turn_observations: int = 7
    #: the tracker's turns are where the course changes by more than so many degrees; None: it has none
    turn_change: float | None = None

    @property
    def documented(self) -> bool:
        return self.compat == "documented"


DEFAULT = Params()
