"""Registered queries, by area; importing the package registers all of them."""

from arborgrid.queries import algebra, clusters, collections, descriptors, features, filling, forests, images, learning, regions, statistics, trips, volumes  # noqa: F401
