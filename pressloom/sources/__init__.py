"""Readers and writers: article records, manifests, CSV folders, progress logs."""
