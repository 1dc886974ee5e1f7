"""Loading of feeds as their files arrive."""
