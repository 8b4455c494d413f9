"""Options as the library and as its real-time application have them when nothing is set."""

from __future__ import annotations

from dataclasses import replace

from ..operators.neighbours import Selection
from ..operators.xcorr import PhaseOptions, XcorrOptions
from .relocate import Options

#: Windows and components of the phase groups.
PHASES = (("P", PhaseOptions(-0.5, 0.5, 0.02, 0.5, ("Z",))), ("S", PhaseOptions(-0.5, 1.0, 0.04, 0.5, ("L2",))))
#: Fixed values of the library.
LIBRARY_SELECTION = Selection(max_km=5.0, min_neighbours=8, max_neighbours=40, min_phases=8, max_phases=0, min_station_km=0.0, max_station_km=0.0, min_ratio=3.0, shells=5)
LIBRARY_XCORR = XcorrOptions(by_phase=PHASES)
LIBRARY = Options(iterations=20, alpha=(10.0, 5.0), damping=(0.01, 0.01), omega=(0.3, 0.3), solver="LSMR", pick_weights=False, min_coefficient=0.7, selection=LIBRARY_SELECTION)
#: Fixed values of the application: a whole catalog by the nearest neighbours, single events by ellipsoids.
APPLICATION_MULTI = replace(LIBRARY, selection=replace(LIBRARY_SELECTION, min_neighbours=4, shells=0))
APPLICATION_SINGLE = replace(LIBRARY, selection=replace(LIBRARY_SELECTION, min_neighbours=4, max_neighbours=80))
APPLICATION_XCORR = XcorrOptions(by_phase=PHASES, max_station_km=60.0, max_event_km=2.0)
