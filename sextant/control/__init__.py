"""What runs on the driver: configuration, run registry, reports, command line."""
