"""Rules and the engine that plans them over shared inputs."""
