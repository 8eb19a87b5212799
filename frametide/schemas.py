"""Explicit schemas of all tables; nothing is inferred."""

FRAMES = "video_id string, frame_idx long, pts double, decodable boolean, h int, w int, rgb binary"
LIB_VECTORS = "vector_id long, key int, t float, vector array<float>"
VIDEOS = "video_id string, key int, source_path string, sha256 string, duration_s double, sample_fps double, n_vectors int, indexed_at string"
Q_FRAMES = "clip_id string, q_idx int, q_t float, vector array<float>"
HITS = "clip_id string, q_idx int, q_t double, rank int, key int, ref_t double, score double"
FILMS = "id string, title string, source string, url string, license string, license_url string, notes string, role string, `group` string, md5 string, archive string, year int, size_bytes long"
QUERY_SPECS = (
    "query_id string, base_id string, film_id string, role string, `group` string, split string, ref_start_s double, ref_duration_s double, length_s double, distortion string, seed long, true_offset_s double"
)
