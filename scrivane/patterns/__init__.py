"""The pattern library: declarative definitions, loaded and checked on the driver."""
