"""Domain tables whose numbers decide the results. Plain data only."""

# Severity words of stored constraints -> (severity, weight); unknown words are hard, 1.0.
SEVERITY = {"HIGH": "hard", "CRITICAL": "hard", "SEVERE": "hard",
            "MEDIUM": "soft", "MODERATE": "soft", "LOW": "soft"}
SEVERITY_WEIGHT = {"MEDIUM": 0.6, "MODERATE": 0.6, "LOW": 0.3}

# Scoring profiles: criterion, weight, direction, unit.
SCORING_PROFILES = {
    "hospital": (
        ("population_served", 0.35, "benefit", "persons"),
        ("travel_time_mean", 0.25, "cost", "seconds"),
        ("distance_to_same_type", 0.15, "benefit", "m"),
        ("flood_risk", 0.15, "cost", "index"),
        ("slope", 0.10, "cost", "degrees"),
    ),
    "school": (
        ("population_served", 0.40, "benefit", "persons"),
        ("travel_time_mean", 0.30, "cost", "seconds"),
        ("distance_to_same_type", 0.20, "benefit", "m"),
        ("flood_risk", 0.10, "cost", "index"),
    ),
    "fire_station": (
        ("travel_time_mean", 0.45, "cost", "seconds"),
        ("population_served", 0.30, "benefit", "persons"),
        ("distance_to_same_type", 0.15, "benefit", "m"),
        ("flood_risk", 0.10, "cost", "index"),
    ),
}

# Planner labels -> (metric, direction, unit).
CRITERION_LABELS = {
    "population": ("population_served", "benefit", "persons"),
    "population served": ("population_served", "benefit", "persons"),
    "accessibility": ("travel_time_mean", "cost", "seconds"),
    "travel time": ("travel_time_mean", "cost", "seconds"),
    "land suitability": ("area", "benefit", "m2"),
    "area": ("area", "benefit", "m2"),
    "flood risk": ("flood_risk", "cost", "index"),
    "flood": ("flood_risk", "cost", "index"),
    "existing coverage": ("distance_to_same_type", "benefit", "m"),
    "coverage": ("distance_to_same_type", "benefit", "m"),
    "distance to same type": ("distance_to_same_type", "benefit", "m"),
    "environment": ("slope", "cost", "degrees"),
    "slope": ("slope", "cost", "degrees"),
    "terrain": ("slope", "cost", "degrees"),
}
CANDIDATE_METRICS = ("area", "distance_to_same_type", "flood_risk", "population_served",
                     "slope", "travel_time_mean")
COST_METRICS = ("travel_time_mean", "flood_risk", "slope")

# Road network.
ROAD_SPEEDS = {"motorway": 80.0, "trunk": 60.0, "primary": 50.0, "arterial": 50.0,
               "secondary": 40.0, "collector": 40.0, "tertiary": 35.0,
               "residential": 25.0, "local": 25.0, "service": 15.0, "footway": 5.0}
# mode -> (speed factor, fixed speed, excluded classes)
TRAVEL_MODES = {"car": (1.0, None, ("footway",)),
                "emergency": (1.3, None, ("footway",)),
                "walk": (1.0, 4.8, ())}
GRAPH_BUILDER_VERSION = "0.1.0"
LANE_WIDTH_M = 3.5
LANE_CAPACITY = {"motorway": 2000.0, "trunk": 1800.0, "primary": 1500.0,
                 "arterial": 1500.0, "secondary": 1200.0, "collector": 1000.0,
                 "tertiary": 900.0, "residential": 600.0, "local": 600.0,
                 "service": 300.0}
TURNOUT_SECONDS = 60.0
RESPONSE_TARGET_SECONDS = 480.0
OFF_NETWORK_WARN_M = 150.0
ACCESS_THRESHOLD_SECONDS = 900.0

# Service standards: units per 1000 persons, unit.
SERVICE_STANDARDS = {"hospital": (1.0, "beds"), "school": (150.0, "seats"),
                     "fire_station": (0.02, "stations"),
                     "water": (135000.0, "litres_per_day"), "clinic": (0.5, "clinics")}

# Hazards: label, road block ratio, road slow ratio, default radius, responder.
HAZARDS = {"fire": ("Urban fire", 0.55, 1.0, 400.0, "fire_station"),
           "flood": ("Flood", 1.0, 1.4, 900.0, "fire_station"),
           "earthquake": ("Earthquake", 0.35, 1.8, 1500.0, "hospital"),
           "chemical": ("Chemical release", 0.9, 1.5, 700.0, "fire_station")}
# Measures: label, quantity reduced, factor, hazards it applies to (None = all).
MEASURES = {
    "early_warning": ("Early warning system", "population_exposed", 0.45, None),
    "flood_barrier": ("Flood barriers", "hazard_radius", 0.70, ("flood",)),
    "fire_break": ("Fire breaks / setbacks", "hazard_radius", 0.75, ("fire",)),
    "building_retrofit": ("Structural retrofit", "buildings_damaged", 0.55, None),
    "road_redundancy": ("Redundant road links", "roads_blocked", 0.60, None),
    "backup_power": ("Backup power at facilities", "facilities_offline", 0.25, None),
}

# Land-cover sensitivity, 0 benign .. 1 severe; other classes 0.3.
SENSITIVITY = {"forest": 1.0, "tree_cover": 1.0, "wetland": 0.95, "water": 0.9,
               "grassland": 0.6, "cropland": 0.5, "shrubland": 0.5, "bare": 0.2,
               "built": 0.05, "built_up": 0.05}
DEFAULT_SENSITIVITY = 0.3
GREEN_COVER = ("forest", "tree_cover", "grassland", "wetland", "shrubland")

# Scenario comparison: metric -> (weight, sense).
COMPARISON = {"coverage_ratio": (0.25, "max"), "mean_travel_time": (0.20, "min"),
              "population_within_threshold": (0.15, "max"),
              "population_exposed": (0.15, "min"), "impact_index": (0.10, "min"),
              "capacity_deficit": (0.08, "min"), "total_cost": (0.07, "min")}

# Unit rates (INR).
CURRENCY = "INR"
UNIT_RATES = {"land_acquisition_per_m2": 6000.0, "road_per_m_local": 12000.0,
              "road_per_m_collector": 22000.0, "road_per_m_arterial": 38000.0,
              "hospital_per_bed": 4500000.0, "school_per_seat": 85000.0,
              "fire_station_fixed": 65000000.0, "site_preparation_per_m2": 900.0,
              "drainage_per_m": 4500.0}
CONTINGENCY_RATE = 0.15
ESCALATION_RATE = 0.0

# The ten score dimensions: key, label, unit, floor, target, weight.
DIMENSIONS = (
    ("mobility", "Mobility & connectivity", "km/km²", 2.0, 12.0, 1.2),
    ("facility_access", "Public facility accessibility", "% within 15 min", 20.0, 95.0, 1.2),
    ("healthcare", "Healthcare & emergency coverage", "beds-equivalent/1000", 0.0, 2.0, 1.3),
    ("education", "Education coverage", "schools/1000", 0.0, 1.0, 1.0),
    ("green_space", "Green / open space", "m²/person", 0.0, 9.0, 1.0),
    ("recreation", "Recreation & public amenities", "per 10k people", 0.0, 5.0, 0.8),
    ("landuse", "Land-use efficiency & structure", "index", 0.0, 1.0, 0.9),
    ("infrastructure", "Infrastructure readiness", "% serviced", 0.0, 100.0, 1.0),
    ("resilience", "Disaster resilience & emergency routing", "index", 0.0, 100.0, 1.3),
    ("constraints", "Environmental & development constraints", "% unconstrained",
     0.0, 100.0, 0.8),
)
BENCHMARKS = {
    "chandigarh": {"mobility": 11.5, "facility_access": 88.0, "healthcare": 1.6,
                   "education": 0.9, "green_space": 15.0, "recreation": 4.2,
                   "landuse": 0.86, "infrastructure": 92.0, "resilience": 74.0,
                   "constraints": 88.0},
    "rotterdam": {"mobility": 13.2, "facility_access": 92.0, "healthcare": 1.8,
                  "education": 0.95, "green_space": 12.0, "recreation": 5.4,
                  "landuse": 0.82, "infrastructure": 96.0, "resilience": 88.0,
                  "constraints": 71.0},
}
BENCHMARK_PAIRING = {"adivali_devad": "chandigarh", "jnpt_port": "rotterdam",
                     "chandigarh": "rotterdam", "rotterdam": "chandigarh"}
HEALTH_WORDS = ("hospital", "clinic", "health", "doctor", "pharmacy", "medical")
EDUCATION_WORDS = ("school", "college", "university", "kindergarten", "education")
RECREATION_WORDS = ("park", "sport", "gym", "swimming", "playground", "community",
                    "library", "theatre", "cultural", "stadium", "recreation")
EMERGENCY_WORDS = ("fire", "police", "ambulance", "emergency")
GREEN_WORDS = ("park", "green", "forest", "recreation", "garden", "open_space",
               "playground")
FRONTAGE_M = 30.0
FLOOD_LIMIT = 0.3

# Development packages.
REMEDIES = {"healthcare": ("hospital", "clinic"), "education": ("school",),
            "recreation": ("recreation",), "green_space": ("park",),
            "resilience": ("fire_station",), "facility_access": ("clinic", "school")}
ROAD_REMEDIES = ("mobility", "infrastructure")
FACILITY_COST = {"hospital": ("hospital_per_bed", 100.0),
                 "clinic": ("hospital_per_bed", 12.0),
                 "school": ("school_per_seat", 600.0),
                 "fire_station": ("fire_station_fixed", 1.0),
                 "park": ("site_preparation_per_m2", 8000.0),
                 "recreation": ("site_preparation_per_m2", 3000.0)}
FACILITY_LABEL = {"hospital": "Hospital", "clinic": "Primary health clinic",
                  "school": "School", "fire_station": "Fire station",
                  "park": "Neighbourhood park",
                  "recreation": "Community recreation centre"}
# facility -> (kind, label, rate key) of what it depends on
DEPENDENCIES = {
    "hospital": (("road", "Access road to {label}", "road_per_m_collector"),
                 ("utility", "Drainage and services for {label}", "drainage_per_m")),
    "clinic": (("road", "Access road to {label}", "road_per_m_local"),),
    "school": (("road", "Access road to {label}", "road_per_m_local"),
               ("utility", "Drainage and services for {label}", "drainage_per_m")),
    "fire_station": (("road", "Priority emergency access to {label}",
                      "road_per_m_arterial"),),
    "park": (("road", "Pedestrian access to {label}", "road_per_m_local"),),
    "recreation": (("road", "Access road to {label}", "road_per_m_local"),),
}
ACCESS_ROAD_M = 250.0
CORRIDOR_M = 1200.0
FACILITY_STEP = 15.0
CORRIDOR_STEP = 12.0
CORRIDOR_SHARE = 0.15
MIN_GAP = 0.5

# Scenario vocabulary.
OPERATIONS = {"INSERT": "add", "ADD": "add", "CREATE": "add", "UPDATE": "modify",
              "MODIFY": "modify", "EDIT": "modify", "DELETE": "delete",
              "REMOVE": "delete", "DROP": "delete"}
ENTITY_NAMES = {"facility": "facility", "facilities": "facility", "parcel": "parcel",
                "land_parcel": "parcel", "land_parcels": "parcel", "road": "road",
                "roads": "road", "building": "building", "buildings": "building",
                "population_zone": "population_zone", "landuse_zone": "landuse_zone",
                "infrastructure_asset": "infrastructure_asset",
                "constraint": "constraint", "planning_constraint": "constraint"}
ENTITY_TYPES = ("building", "road", "parcel", "facility", "population_zone",
                "landuse_zone", "infrastructure_asset", "constraint")
BUILDABLE_TYPES = ("building", "road", "parcel", "facility", "population_zone",
                   "constraint")

# Map ingestion.
INGEST_SPEEDS = {"motorway": 80, "trunk": 60, "primary": 50, "secondary": 40,
                 "tertiary": 40, "residential": 30, "service": 20, "unclassified": 30,
                 "living_street": 20, "footway": 5, "path": 5, "track": 20}
INGEST_AMENITIES = ("hospital", "clinic", "school", "fire_station", "police", "doctors",
                    "college", "university")
INGEST_CAPACITY = {"hospital": 150, "clinic": 50, "school": 300, "college": 800,
                   "university": 2000, "fire_station": 30, "police": 40, "doctors": 20}
INGEST_RADIUS = {"hospital": 3000.0, "clinic": 1500.0, "school": 2000.0,
                 "college": 5000.0, "university": 8000.0, "fire_station": 4000.0,
                 "police": 4000.0, "doctors": 1000.0}
INGEST_ZONING = {"residential": "R1", "commercial": "C1", "industrial": "I1",
                 "farmland": "AG", "forest": "GR", "grass": "GR", "retail": "C2",
                 "construction": "R2"}
TYPICAL_FLOORS = {
    "apartments": 7, "residential": 4, "house": 2, "detached": 2, "bungalow": 2, "hut": 1,
    "shed": 1, "garage": 1, "garages": 1, "roof": 1, "carport": 1, "commercial": 4,
    "retail": 3, "office": 6, "supermarket": 2, "mall": 4, "industrial": 2,
    "warehouse": 2, "factory": 2, "manufacture": 2, "hospital": 5, "school": 3,
    "college": 4, "university": 5, "hotel": 6, "train_station": 2, "civic": 3,
    "government": 4, "public": 3, "temple": 2, "mosque": 2, "church": 2, "religious": 2,
    "shrine": 1, "construction": 3, "yes": 3}
FLOOR_HEIGHT_M = 3.2
FACILITY_CATEGORY = {
    "hospital": "hospital", "clinic": "clinic", "doctors": "doctor",
    "pharmacy": "pharmacy", "dentist": "clinic", "healthcare": "health",
    "nursing_home": "health", "social_facility": "health", "school": "school",
    "college": "college", "university": "university", "kindergarten": "kindergarten",
    "library": "library", "fire_station": "fire_station", "police": "police",
    "ambulance_station": "ambulance", "park": "park", "garden": "garden",
    "playground": "playground", "sports_centre": "sport", "fitness_centre": "gym",
    "pitch": "sport", "swimming_pool": "swimming", "stadium": "stadium",
    "theatre": "theatre", "community_centre": "community", "arts_centre": "cultural",
    "sports_hall": "sport", "recreation_ground": "recreation"}
LANDUSE_CATEGORY = {
    "residential": "residential", "commercial": "commercial", "retail": "commercial",
    "industrial": "industrial", "farmland": "agriculture", "farmyard": "agriculture",
    "orchard": "agriculture", "meadow": "green", "grass": "green",
    "greenfield": "green", "village_green": "green", "forest": "forest",
    "wood": "forest", "recreation_ground": "recreation", "park": "park",
    "garden": "garden", "pitch": "recreation", "cemetery": "open_space",
    "allotments": "green", "construction": "vacant", "brownfield": "vacant",
    "quarry": "industrial", "railway": "infrastructure", "port": "industrial",
    "harbour": "industrial", "military": "restricted",
    "institutional": "institutional", "education": "institutional",
    "religious": "institutional"}

# Regions: west, south, east, north; label.
REGIONS = {"adivali_devad": (73.13, 18.99, 73.15, 19.005),
           "jnpt_port": (72.93, 18.93, 73.0, 18.98),
           "chandigarh": (76.765, 30.73, 76.79, 30.75),
           "rotterdam": (4.45, 51.89, 4.5, 51.92)}
REGION_LABELS = {"adivali_devad": "Adivali-devad (NAINA)", "jnpt_port": "JNPT Port",
                 "chandigarh": "Chandigarh Sector 17", "rotterdam": "Rotterdam"}
REGION_LAYERS = ("roads", "buildings", "water", "bridges")
REGION_CAPS = {("rotterdam", "roads"): 1800, ("rotterdam", "buildings"): 1200,
               ("chandigarh", "buildings"): 1500}
REGION_CAP = 3000

# Population from building footprints.
DEFAULT_FLOORS = 2.0
FLOOR_AREA_PER_PERSON = 30.0
RESIDENTIAL_FRACTION = 0.75
RESIDENTIAL = ("residential", "house", "apartments", "detached", "semidetached_house",
               "terrace", "bungalow", "dormitory", "hut", "cabin", "farm")
NON_RESIDENTIAL = (
    "industrial", "warehouse", "retail", "commercial", "office", "shop", "school",
    "hospital", "church", "mosque", "temple", "garage", "garages", "hangar", "shed",
    "roof", "carport", "farm_auxiliary", "barn", "stable", "service", "transportation",
    "train_station", "civic", "public", "government", "hotel", "supermarket", "kiosk",
    "storage_tank", "silo")
FLOOD_BUFFER_M = 150.0
FLOOD_PROXY_RISK = 0.6
HOUSEHOLD_SIZE = 4.5
WARD_HOUSEHOLD_SIZE = 4.2

# Road proposal: cost rate (crore per km and lane) by road type, else 5.0.
ROAD_RATES = {"arterial": 8.0, "sub-arterial": 6.0, "collector": 4.0, "local": 2.5}

# Colours of exported building blocks.
BUILDING_COLOURS = {"public_hospital": "#E74C3C", "clinic": "#E74C3C",
                    "school": "#3498DB", "commercial": "#F39C12",
                    "public_civic": "#9B59B6", "residential": "#2ECC71",
                    "mixed_use": "#1ABC9C"}
DEFAULT_COLOUR = "#4A90E2"

# Metric name -> (label, unit, better direction).
METRIC_LABELS = {
    "coverage_ratio": ("Coverage", "ratio", "up"),
    "population_total": ("Population", "persons", None),
    "population_within_threshold": ("Population Covered", "persons", "up"),
    "population_unreachable": ("Unreachable", "persons", "down"),
    "mean_travel_time": ("Mean Travel Time", "s", "down"),
    "max_travel_time": ("Max Travel Time", "s", "down"),
    "facilities_evaluated": ("Facilities", "count", None),
    "parcels_evaluated": ("Parcels Evaluated", "count", None),
    "parcels_rejected": ("Parcels Rejected", "count", "down"),
    "nodes": ("Graph Nodes", "count", None),
    "edges": ("Graph Edges", "count", None),
    "connected_components": ("Components", "count", "down"),
    "largest_component_share": ("Largest Component", "ratio", "up"),
    "articulation_points": ("Critical Junctions", "count", "down"),
    "capacity_deficit": ("Capacity Deficit", "units", "down"),
    "required_capacity": ("Required Capacity", "units", None),
    "installed_capacity": ("Installed Capacity", "units", "up"),
    "projected_population": ("Projected Population", "persons", None),
    "zones_assigned": ("Zones Assigned", "count", "up"),
    "zones_unassigned": ("Zones Unassigned", "count", "down"),
}
