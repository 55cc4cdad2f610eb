"""Schemas of the tables that the engine reads and writes."""

DETECTIONS = "frame int, x int, y int, theta double"
TRACKING = "time double, x double, y double, theta double, particle int"
PHYSICS = "pwm int, trial int, omega_fft double, omega_noise double, v_msd double, R double, omega_ucm double"
PIXELS = "video_id long, frame int, i int, j int, b int, g int, r int"
FRAMES = "video_id string, frame int, height int, width int, channels int, data binary"
